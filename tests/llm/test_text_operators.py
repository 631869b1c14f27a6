"""Language ID, decontamination, main text, personal data and byte pairs against plain versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import byte_bpe as bb
from barloom.llm import decontaminate as dc
from barloom.llm import language_id as li
from barloom.llm import line_dedup as ld
from barloom.llm import main_text as mt
from barloom.llm import private_data as pd
from barloom.llm import quotations as qu
from barloom.llm.queries import vocabulary

LETTERS = {"aa": "abcde", "bb": "abxyz"}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def made_up(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, made_up(rng, lang, 40), lang, "other") for i, lang in enumerate(rng.choices(["aa", "bb"], k=90))]
    rows += [(90, None, "aa", "x"), (91, "", None, "x"), (92, "12 .. !", "aa", "x"), (93, made_up(rng, "bb", 9000), None, "x"), (93, made_up(rng, "bb", 30), "bb", "x"), (None, "abcde", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = li.identify(docs).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r.held_out for r in got}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in held if i is not None) and held[None] is False
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang, _ in rows[:90]) and by_id[93].lang_pred == "bb"
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (90, 91, 92)) and all(0 <= r.score <= 1 for r in got)
    nothing = docs.where("FALSE")
    assert li.identify(nothing).count() == 0
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = li.with_language(docs, li.learned(docs))
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and kept.schema["score"].dataType.simpleString() == "double"


def test_bundles_are_those_of_single_ngrams():
    space, letters = li.Space(64), li.letters_of("Ab, c")
    assert bytes(letters.tolist()).decode() == " ab c "
    grams = ["".join(map(chr, letters[k : k + 3])) for k in range(len(letters) - 2)]
    total = sum(space._vector(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])).astype(float) for g in grams)
    assert space.bundle("Ab, c") == pytest.approx(total / (total @ total) ** 0.5, abs=1e-6)


def plain_hits(texts, items, window):
    wins = [(str(i), w[a : a + window]) for i, t in items for w in [dc.words_of(t)] for a in range(max(1, len(w) - window + 1) if w else 0)]
    for text in texts:
        w, hit, found = dc.words_of(text), set(), set()
        for item, p in wins:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    found.add(item)
                    hit.update(range(a, a + len(p)))
        yield len(w), len(hit), sorted(found)


def test_phrases_are_found_as_by_plain_search(spark):
    rng = random.Random(3)
    for trial in range(40):
        words = ["a", "b", "É", "d1", "e", "F"][: rng.randrange(1, 7)]
        some = lambda n: " ".join(rng.choice(words) for _ in range(n))
        items = [(k, rng.choice(["", some(rng.randrange(1, 30)), some(rng.randrange(1, 5))])) for k in range(rng.randrange(6))]
        texts = [rng.choice([None, "", "...", some(rng.randrange(1, 80)), (items[0][1] if items else "") + " zz " + some(5)]) for _ in range(rng.randrange(1, 12))]
        window = rng.choice([2, 3, 5, 13])
        got = [(n, sum(b - a for a, b in spans), ids) for n, spans, ids in dc.shard_hits(texts, dc.Phrases(items, window))]
        assert got == list(plain_hits(texts, items, window))
    rows = [(1, "x a b c d y", 5), (1, "x a b c d y", 5), (2, None, 1), (3, "", 1), (None, "A  B--C d", 1), (4, "q " * 100_000 + "a b c d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(10, "a b c d", 0), (9, "b c d", 0), (None, "x", 0), (11, None, 0)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in dc.contamination(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].items_sha256, got[1].contaminated) == (6, 5, 2, sha("10,9"), True)
    assert (got[2].n_words, got[3].n_words, got[2].items_sha256, got[None].n_hit) == (0, 0, sha(""), 4)
    assert (got[4].n_words, got[4].n_hit, got[4].contaminated) == (100_004, 4, False)
    twice = {r.doc_id: r for r in dc.contamination(docs.where("doc_id > 1"), bench, phrase_words=1).collect()}
    assert twice[4].n_hit == 4 and twice[4].items_sha256 == sha("10,9") and [tuple(s) for s in twice[4].spans] == [(100_000, 100_004)]
    assert sorted(str(r.doc_id) for r in dc.drop_contaminated(docs, bench).collect()) == ["2", "3", "4"]
    assert dc.drop_contaminated(docs, bench).columns == docs.columns
    assert dc.contamination(docs, bench.where("FALSE")).where("n_hit > 0").count() == 0 and dc.contamination(docs.where("FALSE"), bench).count() == 0


PAGE = """<html><body><header><h2>Site</h2></header><div class="with-sidebar"><div class="sidebar">side text that is quite long too</div>
<div class="content"><h1>Title &amp; more</h1><p>First   para <a href=x>link</a> of text<br>that is long enough, surely it is.</p><ul><li>item one<li>item two</ul>
<p>Second para that is also long enough to count as text here and now.</div><div id="comments"><p>Reader comment that is quite long and full of opinion.</p></div></div>
<form><label>Name</label></form><div class="cookie-notice">We use cookies</div><script>"<p>x</p>"</script><footer>foot</footer></body></html>"""


def test_main_text(spark):
    body = "Title & more\nFirst para link of text that is long enough, surely it is.\nitem one\nitem two\nSecond para that is also long enough to count as text here and now."
    long = "<p>" + "word " * 100_000
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (4, "w", "a < b &lt;i&gt; only text", "t"), (5, "x", long, "t"), (None, "y", "<script>x</script>", "t"), (6, "z", "<div>" * 2000 + "deep", "t")]
    got = [tuple(r) for r in mt.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    assert sorted(got, key=str)[:2] == [(1, "u", body, len(body))] * 2
    by_id = {r[0]: r[2] for r in got}
    assert (by_id[2], by_id[3], by_id[4], by_id[None], by_id[6]) == ("", "", "a < b <i> only text", "", "deep") and by_id[5] == ("word " * 100_000).strip()
    assert mt.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, form, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(form, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pd.luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_follow_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice(["1", "25", "4", "0", "00", "300", "@", "a.b", "a", ".", " ", "-", "+", "(", ")", "é", "4111 1111 1111 1111", "_"]) for _ in range(rng.randrange(1, 14)))
        assert pd.base_spans(text) == plain_spans(text)


def test_the_field_sums_and_maximises_over_all_segmentations():
    field = pd.SemiMarkovField()
    field.weights = pd.np.random.default_rng(2).normal(size=pd.WIDTH)
    run = next(pd.runs_of("call 12 345-6789 012 3456"))
    scores = field.scores(run)
    ways, done = [([], 0)], []
    while ways:
        path, at = ways.pop()
        if at == run.size:
            done.append(path)
        ways += [([*path, k], e[1]) for k, e in enumerate(run.edges) if e[0] == at and at < run.size]
    weight = [pd.math.exp(sum(scores[k] for k in path)) for path in done]
    assert field.marginals(run, scores) == pytest.approx([sum(w for w, p in zip(weight, done) if k in p) / sum(weight) for k in range(len(scores))])
    assert field.best(run, scores) == done[weight.index(max(weight))]


def test_personal_data(spark):
    rng = random.Random(7)
    texts = [f"mail a{i}.b@host{i}.example.com or +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} from {rng.randrange(1, 255)}.0.0.{i % 255} in {1900 + i}" for i in range(120)]
    odd = [None, "", texts[0], texts[0], "write to jo (at) mail (dot) example (dot) com please", "x" * 200_000 + " a@b.cc", "1 " * 20_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + odd)] + [(None, "a@b.cc", "s")], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pd.find_private(docs, pd.learn(docs)).collect()}
    assert len(rows) == len(texts) + len(odd) + 1
    for i, text in enumerate(texts + odd):
        base, r = plain_spans(text or ""), rows[i]
        kinds = [k for k, _, _ in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pd.KINDS] and r.base_sha256 == sha(pd.joined(base))
        assert {pd.joined([s]) for s in base} <= set(r.spans.split(","))
    assert rows[124].spans == "email:9:45" and rows[124].n_email == 0 and rows[None].n_email == 1
    assert pd.find_private(docs.where("FALSE"), pd.learn(docs.where("FALSE"))).count() == 0


def test_byte_pairs_equal_the_public_encoder(spark):
    import tiktoken

    path, pattern = vocabulary()
    ranks = bb.read_ranks(open(path, "rb").read())
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x4E00, 0x4F00), [32, 10, 9, 0x3000], [0x1F600, 0x200D]]
    texts = ["", " ", "a", "it's  two\n\n x", "\x00 a", "a \n", "!" * 300, "ab" * 400, "x" * 64, "y" * 65, "z " * 30_000, "日本語" * 500]
    texts += ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    bpe = bb.ByteBpe(ranks, pattern)
    for text in texts:
        ids = bpe.encode(text)
        assert ids == encoder.encode_ordinary(text) and bpe.decode(ids) == text.encode()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (-1, None, "x"), (None, "a b", "x")], "doc_id long, text string, id string")
    got = {r.doc_id: tuple(r)[1:] for r in bb.token_digests(docs, path, pattern).collect()}
    for i, text in [*enumerate(texts), (-1, ""), (None, "a b")]:
        ids = encoder.encode_ordinary(text)
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(text))
    back = bb.decode_ids(bb.encode_texts(docs, path, pattern), path)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == {**dict(enumerate(texts)), -1: "", None: "a b"}
    assert bb.token_digests(docs.where("FALSE"), path, pattern).count() == 0


def test_lines_of_many_sites_stay_once(spark):
    rng = random.Random(2)
    common, lines = ["This line is everywhere", "One more such line"], [f"some words of line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choices(common + lines, k=rng.randrange(1, 8)) + ["two words"]), f"s{rng.randrange(14)}", "k") for i in range(150)]
    rows += [(150, None, "s1", "k"), (151, "", "s1", "k"), (152, "This line is everywhere ", None, "k"), (None, "This line is everywhere", "s2", "k"), (153, "\n".join(["This line is everywhere"] * 3000), "s3", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed string")
    got = {r.doc_id: r for r in ld.dedup_lines(docs, log_registers=4).collect()}
    sites, seen = {}, set()
    for _, text, site, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip() and site:
                sites.setdefault(line.strip(" "), set()).add(site)
    for i, text, _, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            key = line.strip(" ")
            if len(sites.get(key, ())) >= 10 and key.strip():
                if key in seen:
                    continue
                seen.add(key)
            kept.append(line)
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(text.split("\n")) - len(kept) and got[i].n_lines == len(text.split("\n"))
    assert got[150].text is None and got[150].n_lines == got[150].n_removed == 0 and got[None].text == "This line is everywhere"
    assert ld.dedup_lines(docs.where("FALSE")).count() == 0 and "n_sites" not in ld.dedup_lines(docs).columns


TALK = [
    (1, 0, "user", "Hello there.\nHow are you?\n\nSecond paragraph here."), (1, 1, "assistant", "> How are  YOU?\nFine, thanks."), (1, 2, "user", "On Monday, A wrote:\n> Fine, thanks.\n>> How are you?\n\nGood.\n"),
    (1, 3, "assistant", "> Second paragraph here.\n> something unknown\nAnswer\n> > nested first\n"), (1, 4, "user", None), (1, 4, "user", None), (1, 5, None, ">"), (1, 6, "user", "> Hello there. How are you?\nok"),
    (2, 0, "user", "> Hello there.\nx"), (None, 0, "user", "a"), (3, None, "user", "b"), (4, 7, "user", "a"), (4, 7, "assistant", "> a\nb"), (4, 9, "user", "> b\n> a\n"), (5, 0, "user", "y " * 50_000), (5, 1, "user", "> " + "y " * 50_000),
]


def test_quotes_are_linked(spark):
    import duckdb

    talk = spark.createDataFrame([(*t, "k") for t in TALK], "conv_id long, turn long, role string, text string, key string")
    got = sorted((tuple(r) for r in qu.link_quotes(talk).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TALK)
    assert got == sorted(con.execute(qu.SQL).fetchall(), key=str)
    by_turn = {(r[0], r[2], r[3]): r for r in got}
    assert by_turn[(1, 2, "user")] == (1, 2, 2, "user", 1, 2, 2, "Good.") and by_turn[(1, 3, "assistant")][4:] == (0, 2, 1, "Answer") and by_turn[(5, 1, "user")][4:] == (0, 1, 1, "")
    first = qu.chats(qu.link_quotes(talk), page=3).where("conv_id = 1").orderBy("page").collect()
    assert [len(r.messages) for r in first] == [3, 3, 1] and tuple(first[0].messages[1]) == ("assistant", "Fine, thanks.")
    assert qu.link_quotes(talk.where("FALSE")).count() == 0
