"""Near duplicates, repeated substrings, exact search, the pipeline and the package's borders, against plain versions."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from barloom.llm import exact_topk as et
from barloom.llm import ngram_join as nj
from barloom.llm import substring_dedup as sd
from barloom.llm.decontaminate import words_of

ROOT = Path(__file__).resolve().parent.parent.parent


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 200))] for _ in range(12)]
    texts = [None, "", "...", "one two", "One, two!", "w1 w2 w3 w4 w5 w6", "z " * 20_000, "z " * 30_000]
    for _ in range(120):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own) + rng.choice(["", ".", "!"]))
    sets, n = [shingle_set(t) for t in texts], len(texts)
    links, top = [0] * n, list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1), (9, texts[9], 1)], "doc_id long, text string, rep int")
    rows = nj.near_duplicates(docs, block=7).collect()
    got = {r.doc_id: r for r in rows}
    # Row 9 stands there twice: it is one document more for itself and for all that reach the threshold with it.
    twice = [i for i in range(n) if sets[i] and sets[9] and len(sets[i] & sets[9]) / len(sets[i] | sets[9]) >= 0.8]
    assert len(rows) == n + 1 and {i: (got[i].class_id, got[i].n_links) for i in range(n)} == {i: (root(i), links[i] + (i in twice)) for i in range(n)}
    members, links = nj.link_kinds(docs, block=7, explicit=True)
    rep = {r.id: r.rep for r in members.collect()}
    wanted = {(rep[i], rep[j]) for i in range(n) for j in range(n) if sets[i] and sets[j] and rep[i] < rep[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert sorted((r.a, r.b) for r in links.collect()) == sorted(wanted)
    assert nj.near_duplicates(docs.where("FALSE")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    floors = nj.least_matches(0.8, 1e-9, 128)
    assert floors == sorted(floors) and floors[-1] < 0.65 * 128
    rng = np.random.default_rng(1)
    # Of a million pairs at the threshold none falls below a floor.
    matches = np.cumsum(rng.binomial(16, 0.8, (1_000_000, 8)), axis=1)
    assert (matches >= np.array(floors)).all()


def plain_repeats(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        hit = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        yield len(t), sum(hit), sum(1 for k in range(len(t)) if hit[k] and (k == 0 or not hit[k - 1])), bytes(b for b, x in zip(t, hit) if not x)


def pieces(rng, n):
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(100, 900))) for _ in range(6)]
    noise = lambda: "".join(rng.choice("xyz") for _ in range(rng.randrange(300)))
    for _ in range(n):
        own = rng.choice(base)
        at = rng.randrange(len(own))
        edited = "".join("#" if rng.random() < 0.004 else c for c in own)
        yield rng.choice([None, "", own, edited, edited, noise() + own[at : at + rng.randrange(150, 260)] + noise(), "ab" * rng.randrange(50, 300), own + rng.choice(base)])


@pytest.mark.parametrize("group", [512, 2])
def test_repeated_strings_go(spark, group):
    texts = list(pieces(random.Random(group), 50))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, rid int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == list(plain_repeats([(t or "").encode() for t in texts], 200))
    assert sd.remove_repeats(docs.where("FALSE")).count() == 0


def test_rows_that_repeat_lose_what_they_share(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300_000))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in sd.remove_repeats(docs).collect())
    assert got == [("1", 300_000, 300_000, 1)] * 2 + [("2", 5, 0, 0), ("None", 5, 0, 0)]


def test_chunks_do_not_matter():
    data = np.frombuffer("".join(random.Random(3).choice("ab") for _ in range(5000)).encode(), np.uint8)
    ends = np.array([100, 100, 2500, 5000])
    windows = lambda parts: {(int(f) + k, int(f) + int(m)) for f, size, m, *_ in zip(*parts) for k in range(int(size) - 199)}
    assert windows(sd.anchors(data, ends, chunk=700)) == windows(sd.anchors(data, ends))


def test_deep_shallow_order():
    rng = random.Random(2)
    for trial in range(200):
        letters = rng.sample("abcdefgh", rng.choice([1, 2, 5]))
        some = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))).encode() for _ in range(rng.randrange(1, 60))]
        order, lcp = sd.deep_shallow(some, 0, rng.choice([1, 3, 16]))
        assert [some[k] for k in order] == sorted(some) and lcp[1:] == [sd.common(some[a], some[b]) for a, b in zip(order, order[1:])]


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, d = rng.integers(1, 300), rng.integers(1, 9)
        vectors = rng.integers(-3, 4, (n, d)).astype(float) if trial % 2 else np.floor(rng.normal(0, 20, (n, d)))
        ids, asked, own = rng.permutation(1000)[:n], np.floor(rng.normal(0, 5, (5, d))), rng.choice(1000, 5)
        index = et.ImpactIndex(ids, vectors)
        for q, o, (places, scores) in zip(asked, own, index.best(asked, own, 7, int(rng.integers(1, 50)))):
            assert [(-s, i) for s, i in zip(scores, index.ids[places])] == sorted((-(x @ q), i) for x, i in zip(vectors, ids) if i != o)[:7]


def test_search_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)], "k") for i in range(200)]
    rows += [(300, None, "k"), (301, [0.1, None, 0.0, 0.0, 0.0, 0.0], "k"), (302, [float("nan")] * 6, "k"), (303, [float("inf")] + [0.0] * 5, "k"), (304, [], "k"), (305, rows[7][1], "k"), (305, rows[7][1], "k"), (306, [1.0, 2.0], "k"), (None, rows[3][1], "k"), (320, [0.5, 0.5], "k")]
    vectors = et.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in et.top_k(vectors, et.every(vectors), 5, candidate_rows=40, query_rows=3).collect()}
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i is not None and (i < 300 or i in (305, 306, 320))]
    want = {}
    for q, x in whole:
        if q % 20 == 0:
            for rank, (score, i) in enumerate(sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:5], 1):
                want[(q, rank)] = (i, -score)
    assert got == want and et.top_k(vectors.where("FALSE"), vectors.where("FALSE")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    clean, item = [sentence() for _ in range(20)], " ".join(f"b{k}" for k in range(20))
    near = clean[0].split()
    near[30] = "changed"
    rows = [(i, t, "en", f"s{i % 12}") for i, t in enumerate(clean)] + [(20, clean[0], "en", "s1"), (21, " ".join(near), "en", "s2"), (22, "1234", "en", "s1"), (23, None, None, "s1"), (24, "here it is " + item, "en", "s3")]
    rows += [(30 + k, f"Line on every single site\n{sentence()}", "en", f"s{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS LONG) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = nj.stored(stage(spark, got, str(tmp_path)), name)
        assert got.columns == docs.columns
        kept[name] = {r.doc_id: r for r in got.collect()}
    assert set(kept["language_id"]) == {r[0] for r in rows} - {22, 23}
    lines = kept["line_dedup"]
    assert lines[30].text.startswith("Line on") and all(not lines[k].text.startswith("Line on") and lines[k].n_chars == len(lines[k].text) for k in range(31, 42))
    assert set(kept["ngram_jaccard_join"]) == set(lines) - {20, 21} and set(kept["benchmark_decontamination"]) == set(lines) - {20, 21, 24}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["benchmark_decontamination"])


def test_the_rest_stands_without_the_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; names = e.queries(); assert names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)
    users = [p for p in (ROOT / "barloom").rglob("*.py") if "llm" not in p.parts and "barloom.llm" in p.read_text()]
    assert not users
