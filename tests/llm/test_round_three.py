"""Quality rules, spelling variants and collocations beside plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import collocations as co
from barloom.llm import quality_rules as qr
from barloom.llm import spelling_variants as sv

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, lang string, row string, n_words int, doc string, lost int, host string, word int"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, la, "r", 777, "d", 1, "h", 5) for i, t, s, la in rows], SCHEMA)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


# --- quality rules -----------------------------------------------------------------------------


def plain_quality(rows, most=10, one_in=1000):
    def split(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def norm(line):
        return re.sub("[0-9]", "0", " ".join(split(line)).translate(LOW))

    docs, hosts = defaultdict(set), Counter()
    for k, (_, text, host, _) in enumerate(rows):
        if host is not None:
            hosts[host] += 1
            for line in (text or "").split("\n"):
                if split(line):
                    docs[host, norm(line)].add(k)
    out = []
    for i, text, host, _ in rows:
        words, text = split(text), text or ""
        lines = [x for x in text.split("\n") if split(x)]
        inside, at = set(), defaultdict(list)
        for k in range(len(words) - 2):
            at[tuple(words[k : k + 3])].append(k)
        for places in at.values():
            if len(places) > 1:
                inside |= {p + k for p in places for k in range(3)}
        left = sum(len(split(x)) for x in lines if not (len(n := docs[host, norm(x)]) > most and len(n) * one_in > hosts[host]))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed, not failed and 2 * left >= len(words), left))
    return sorted(map(str, out))


def quality_rows():
    rng = random.Random(5)
    words = [f"w{k}#" if k % 7 == 0 else f"wörd{k}" for k in range(60)]
    rows = []
    for k in range(80):
        own = [prose(rng, rng.randint(0, 40), words) for _ in range(rng.randint(0, 5))]
        own += [f"Read  More {k}", "\tread more 7 "] * (k % 3 == 0) + ["footer of the site with some more words than most lines " * 3] * (k % 2)
        rng.shuffle(own)
        rows.append((k // 2, "\n".join(own), f"s{k % 2}" if k % 11 else None, "en"))
    return rows + [(None, None, "s0", None), (5, "", None, None), (7, "\n \n \n\r", "s1", "x"), (8, "a b c " * 5000, "s0", "x"), (9, prose(rng, 200_000, words), "s0", "en")] + [(70, "x\ny\n" + prose(rng, 60, words) + "\n\nx", "s1", "en")] * 12


def test_quality_agrees_with_a_plain_count(spark):
    rows = quality_rows()
    for most, one_in in ((10, 1000), (3, 1000), (10, 3), (11, 2)):
        got = qr.quality(table(spark, rows).repartition(7), most_docs=most, one_in=one_in).collect()
        assert sorted(str(tuple(r)) for r in got) == plain_quality(rows, most, one_in)
    assert {r.kept for r in got} == {r.base_failed for r in got} == {True, False}
    assert qr.quality(table(spark, [])).collect() == []


def test_common_lines_go_and_columns_stay(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = [(k, f"Page {k % 10}\n{prose(rng, 80, words)}\n\n tail", "a", "en") for k in range(12)] + [(99, "Page 1\n" + prose(rng, 70, words), "b", None), (1, "few words", "a", None), (2, None, None, None)]
    docs = table(spark, rows)
    got = qr.without_common_lines(docs)
    assert got.schema == docs.schema
    found = got.collect()
    want = {(i, t if s == "b" else "\n".join(t.split("\n")[1:3])) for i, t, s, _ in rows[:13]}
    assert {(r.doc_id, r.text) for r in found} == want and {r.n_words for r in found} == {777}
    assert qr.without_common_lines(table(spark, [])).collect() == []


# --- spelling variants -------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, factor=2):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root(w)) for w, n in counts.items())


def vocabulary(seed, n, letters="abcdeé", sizes=(1, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)} | {"ab" * 300, "ab" * 299 + "a", "ab" * 299 + "aa"}
    return {w: int(1.5 ** rng.randint(0, 16)) + 1 for w in words}


@pytest.mark.parametrize("block", [1, 60, 900, sv.BLOCK_LETTERS])
def test_variants_agree_with_all_pairs(spark, block):
    counts = vocabulary(block, 500)
    df = spark.createDataFrame([(w, n, 9, "x") for w, n in counts.items()], "word string, n long, n_near int, top string")
    got = sv.variants(df, block_letters=block).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == plain_variants(counts)


def test_letters_in_another_order_are_not_near():
    words = ["abcde", "bacde", "abcdf", "fbcde", "ebcda"]
    tree = sv.LetterTree(words)
    assert sorted(zip(*map(list, tree.near(["abcde"], False)), strict=True)) == [(0, 2), (0, 3)]
    assert sorted(p for _, p in zip(*tree.near(["abcdez", "abczdf", "zzabcde"[1:], "zabcdez"[:6]], True), strict=True)) == [0, 0, 0, 2]
    many = ["".join(p) for p in __import__("itertools").permutations("abcde")] * 1
    assert [many[p] for p in sv.LetterTree(many).near(["abcdf"], False)[1]] == ["abcde"]


def test_words_and_planted_damage(spark):
    rows = [(k, f"Ünder the Étage étage naïve×word {k} don't ABC ÀB {'verbose ' * (k % 9)}Verbosé", "s", "en") for k in range(300)] + [(None, "verbose", None, None), (1, None, "s", None), (2, "", "s", None)] * 2
    want = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert any(w not in "".join(str(r[1]).translate(LOW) for r in rows) for w in want)
    got = sv.spelling(table(spark, rows), damage=97).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == plain_variants(want)
    assert sv.spelling(table(spark, [])).collect() == []


def test_vocabulary_rows_add_up_and_chains_are_followed(spark):
    names = ["aaaaaaaaaa"] + ["a" * (9 - k) + "b" * (k + 1) for k in range(9)]
    rows = [(w, 2 ** (k + 1)) for k, w in enumerate(names)] + [(names[0], 1), (None, 5), ("", 5), ("zzzz", None)]
    rows[0] = (names[0], 0)
    got = {r.word: r.root for r in sv.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == dict.fromkeys(names, names[-1])
    with pytest.raises(ValueError):
        sv.variants(spark.createDataFrame(rows, "word string, n long"), factor=1)


# --- collocations ------------------------------------------------------------------------------


def plain_collocations(rows, support, top):
    counts, sizes = Counter(), Counter()
    for _, text, _, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[k : k + n])] += 1
    cand = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= support}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        cuts = [(int(Fraction(2_000_000 * a, counts[lang, p[:k]] + counts[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(la == lang and len(o) > len(p) and 100 * f >= 80 * a and any(o[j : j + len(p)] == p for j in range(len(o))) for (la, o), f in cand.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, n, p, -a, x, y, sizes[lang], -score) for lang, own in out.items() for n, (score, a, p, x, y) in enumerate(sorted(own, key=lambda r: (*r[:2], r[2].encode()))[:top], 1))


def phrase_rows():
    rng = random.Random(3)
    rows = []
    for k in range(160):
        words = [f"{c}{j}" for c in "aÉ " for j in range(6)] + ["new york city", "New York", "of the, and", "x.y", "z\tz z z z"]
        rows.append((k // 2, ".".join(prose(rng, rng.randint(0, 60), words) for _ in range(3)), None, ("en", "fr", None)[k % 3] if k % 40 else f"rare{k}"))
    return rows + [(1, None, None, "en"), (None, "", None, None), (2, "..,\n!", None, "none"), (3, "long text of words " * 20_000, None, "fr"), (4, "u v w x " * 40, None, "solo")] + [(9, "one two three", None, "en")] * 40


@pytest.mark.parametrize("options", [{}, {"shards": 1}, {"shards": 3, "shard_words": 2_000}, {"shards": 40, "shard_words": 1}])
def test_collocations_agree_with_a_plain_count(spark, options):
    rows = phrase_rows()
    for support, top in ((30, 2000), (7, 25)):
        got = co.collocations(table(spark, rows).repartition(40), support=support, top=top, **options).collect()
        assert sorted(map(tuple, got)) == plain_collocations(rows, support, top)


@pytest.mark.parametrize("answer", [None, False, "last"])
def test_passes_over_the_same_shards_and_over_others(spark, monkeypatch, tmp_path, answer):
    rows, same, told = phrase_rows(), co._same, []
    table(spark, rows).repartition(6).write.parquet(f"{tmp_path}/docs")

    def judge(one, other):
        told.append(same(one, other))
        return told[-1] if answer is None else answer == "last" and len(told) < 4

    monkeypatch.setattr(co, "_same", judge)
    got = co.collocations(spark.read.parquet(f"{tmp_path}/docs"), support=12, shards=5).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 12, 2000)
    assert told == [True] * (3 if answer is False else 4)


@pytest.mark.parametrize("shards, passes", [(5, 2), (12, 4)])
def test_longer_phrases_take_one_pass_while_shares_are_two(spark, monkeypatch, shards, passes):
    rows, mined, calls = phrase_rows(), co.mined, []
    monkeypatch.setattr(co, "mined", lambda *args: calls.append(args) or mined(*args))
    got = co.collocations(table(spark, rows).repartition(20), support=12, shards=shards).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 12, 2000)
    assert len(calls) == passes


@pytest.mark.parametrize("most", [0, 3, (1 << 64) - 1])
def test_phrases_of_one_hash_are_told_apart(monkeypatch, most):
    mixed, plain, text = co.mixed, Counter(), co.Text()
    monkeypatch.setattr(co, "mixed", lambda *args: mixed(*args) & np.uint64(most))
    monkeypatch.setattr(co, "SORTED", 100)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    for t in texts:
        words = t.split()
        plain.update(" ".join(words[k : k + n]) for n in range(1, 5) for k in range(len(words) - n + 1))
    text.add(texts)
    for support, least, below in ((1, None, None), (4, None, None), (4, 2, None), (1, None, 3)):
        found = [(p, int(n)) for some, counts in text.phrases(4, support, least=least, below=below) for p, n in zip(some, counts, strict=True)]
        assert sorted(found) == sorted((p, n) for p, n in plain.items() if n >= support and (below is None or n < below) and p.count(" ") + 1 >= (least or 1))


def test_marks_tell_shards_apart(spark):
    one = spark.createDataFrame([("en", "", 5), ("en", None, 5)], "lang string, phrase string, n long")
    assert co._same(one, one) and not co._same(one, one.limit(1)) and not co._same(one, one.withColumn("n", one.n + 1))


def test_the_filter_of_phrases_and_the_empty_table(spark):
    phrases = [("en", f"w{k} x{k % 7}") for k in range(5000)]
    bits = co.phrase_filter(spark.createDataFrame(phrases, "lang string, phrase string").repartition(3), len(phrases))
    assert len(bits) * 64 == 1 << 17
    texts = co.Text()
    texts.add([p for _, p in phrases[:100]])
    found = [p for some, _ in texts.phrases(4, 1) for p in some]
    assert {"w1", "x1", "w1 x1"} <= set(found) and "x1 w2" not in found
    assert co.collocations(table(spark, [])).collect() == []
    assert co.collocations(table(spark, [(1, None, None, None), (2, " . ", "a", "en")])).collect() == []


# --- the pipeline keeps rows and columns -------------------------------------------------------


@pytest.mark.parametrize("langs", [None, "und", "en"])
def test_the_pipeline_keeps_clean_documents_and_columns(spark, langs):
    import corpus_pipeline as cp

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("ne", "sa", "r", "tup")]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words int, score string, lang_pred string, spans int, n_lines int, __drop int, __id int, row int, doc int, items int"
    clean = [(k // 2, prose(rng, 40, words), langs, f"s{k}") for k in range(20)]
    rows = clean + [clean[0], clean[0], (None, clean[1][1], None, None), (50, None, langs, "s"), (51, " 12 ", langs, None), (52, "x " * 50_000, None, "s")]
    docs = spark.createDataFrame([(*r, 1, 777, "mine", "mine", 8, 9, 10, 11, 12, 13, 14) for r in rows], names)

    def stage(name, df, folder=None):
        return dict(cp.STAGES)[name](spark, df, folder)

    read = stage("language_id", docs)
    assert read.columns == docs.columns and read.count() == len(rows) - 2
    cut = stage("line_dedup", read)
    one = stage("ngram_jaccard_join", cut)
    assert one.columns == docs.columns
    got = one.collect()
    assert sorted(r.text.strip() for r in got) == sorted({r[1].strip() for r in rows if r[1] and r[0] != 51})
    assert {tuple(r)[5:] for r in got} == {(777, "mine", "mine", 8, 9, 10, 11, 12, 13, 14)}
    from barloom.llm.decontaminate import drop_contaminated

    bench = spark.createDataFrame([(None, clean[3][1]), (7, "none of it")], "item_id long, text string")
    left = drop_contaminated(one, bench)
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} == {tuple(r) for r in got if r.text != clean[3][1]}
    empty = docs.where("FALSE")
    for name in ("language_id", "line_dedup", "ngram_jaccard_join"):
        assert stage(name, empty).count() == 0
