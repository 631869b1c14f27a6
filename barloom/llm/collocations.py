"""Phrase collocations by the partition method (SON).

1. The text is cut into shards of a bounded number of words. A shard is mined completely at its share of the support: a
   phrase that occurs ``support`` times in all has that share in one shard at least. So the union of what shards find
   holds every frequent phrase.
2. A shard that is silent about a phrase holds it less often than its own support. These bounds drop candidates that
   can't get there, and tell which ones are counted already: those that no shard can hide.
3. Phrases of one word are mined first, then all longer ones in one pass, of candidate words only. From as many shards
   as the support on, a share of it is a single occurrence, and then it is the candidates of all shards that keep a shard
   from telling of everything it holds: there each length has a pass, filtered by the candidates of those before. They
   are told from other phrases by a Bloom filter of bounded size.
4. If any candidate is left open, shards tell by the same filter what they had kept to themselves; what passes it by
   mistake is told too, and falls with the support. That needs the same shards as before: each pass brings a mark of
   them, and if these differ, shards are filtered by their own bounds and all candidates counted in all of them.

Phrases of up to four words and of one are counted alike, so the parts of every phrase are in the same table. Scores,
containment and ranks are DataFrame work.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from barloom.llm.storage import stored

SUPPORT, MOST_WORDS, TOP, COVERED, SCALE, UNKNOWN = 30, 4, 2000, 80, 2_000_000, "und"
#: Words that a task holds at a time, shards at least (for parallel work), bytes of text a shard is planned for.
SHARD_WORDS, LEAST_SHARDS, SHARD_BYTES = 16_000_000, 12, 64 << 20
#: Characters split, places sorted, and phrases given, at a time.
SPLIT_CHARS, SORTED, YIELDED = 1 << 20, 300_000, 50_000
#: Stands for no part of the places; parts are fewer.
NO_PART = (1 << 16) - 1
#: Bits of the filter for a candidate, and its bounds (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Bits of a mark, so that the sum of some millions is a long.
MARK = (1 << 40) - 1
#: Languages whose size the driver keeps; texts of others are mined at a support of one, which is as exact.
MOST_LANGUAGES = 1000
#: A-Z are lower-cased; . , ; : ! ? and line ends (0A-0D) end a piece. FF isn't a byte of any text.
FOLD = bytes(b | 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
END = b"\xff"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its prefix and its last word."""
    h = (prefix * FACTOR) ^ word
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Text:
    """Words of one language in one shard, as numbers; 0 ends a piece."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(lambda: len(self.number))
        self.number[END] = 0
        self.ids = array("i")
        self.words = self.bytes = self.mark = 0

    def add(self, texts: list[str]) -> None:
        data = "\n".join(texts).encode()
        self.bytes += len(data) - len(texts) + 1
        self.mark = xxh3_64_intdigest(data, self.mark)
        words = data.translate(FOLD).replace(END, b" \xff ").split()
        words.append(END)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.words += int((ids > 0).sum())
        self.ids.frombytes(ids.tobytes())

    def phrases(self, most_words: int, support: int, admits: Callable[[np.ndarray], np.ndarray] | None = None, seed: int = 0, least: int | None = None, below: int | None = None) -> Iterator[tuple[list[str], np.ndarray]]:
        """All phrases found ``support`` times or more, of one word up to ``most_words``, and their counts. With
        ``admits`` only those whose hash it lets pass, as do those of all that they begin and end with. With ``least``
        those of so many words or more, which needn't pass themselves; with ``below`` those found less often than that."""
        ids, words = np.frombuffer(self.ids, np.int32), pa.array(list(self.number), pa.binary())
        hashes = np.fromiter(map(xxh3_64_intdigest, self.number), np.uint64, len(words))

        def hashed(at: np.ndarray, size: int) -> np.ndarray:
            """Hashes of the phrases at these places; those of all places would take more room than the words."""
            h = np.full(len(at), seed, np.uint64)
            for k in range(size):
                h = mixed(h, hashes[ids[at + k]])
            return h

        alive = ids > 0  # the phrases that start at each place
        for size in range(1, most_words + 1):
            if size > 1:
                alive[:-1] &= alive[1:]
                alive[-1] = False
            # Equal phrases become neighbours, a part of the places at a time, dealt out by their hashes.
            parts = min(NO_PART, 1 + int(np.count_nonzero(alive)) // SORTED)
            dealt = np.full(len(ids), NO_PART, np.uint16)
            for start in range(0, len(ids), SORTED):
                at = start + np.flatnonzero(alive[start : start + SORTED])
                h = hashed(at, size)
                if admits and (least is None or size < least):
                    alive[at] = passed = admits(h)
                    at, h = at[passed], h[passed]
                dealt[at] = (h >> np.uint64(40)) % np.uint64(parts)
            if least is not None and size < least:
                continue
            for part in range(parts):
                own = np.flatnonzero(dealt == part)
                own, starts = _neighbours(ids, own, hashed(own, size), size)
                counts = np.diff(np.append(starts, len(own)))
                often = counts >= support
                given = np.flatnonzero(often if below is None else often & (counts < below))
                for some in np.array_split(given, 1 + len(given) // YIELDED):
                    first = own[starts[some]]
                    yield pc.binary_join_element_wise(*[words.take(pa.array(ids[first + k])) for k in range(size)], b" ").cast(pa.string()).to_pylist(), counts[some]
                alive[own[np.repeat(~often, counts)]] = False


def _neighbours(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places sorted by their phrases, and where each phrase begins among them."""

    def others() -> np.ndarray:
        differ = np.zeros(max(0, len(at) - 1), bool)
        for k in range(size):
            word = ids[at + k]
            differ |= word[1:] != word[:-1]
        return differ

    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    differ = others()
    if (differ & (hashes[1:] == hashes[:-1])).any():  # two phrases of one hash
        at = at[np.lexsort([ids[at + k] for k in range(size)])]
        differ = others()
    return at, np.flatnonzero(np.concatenate([[True], differ])[: len(at)])


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[dict[str, Text]]:
    """The texts of a task by language; a new shard begins when one is full. A batch is split a part at a time."""
    shard: defaultdict[str, Text] = defaultdict(Text)
    for batch in batches:
        texts: defaultdict[str, list[str]] = defaultdict(list)
        size = 0
        for start in range(0, batch.num_rows, 500):
            some = batch.slice(start, 500)
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
                size += len(text)
            if size > SPLIT_CHARS or start + 500 >= batch.num_rows:
                while texts:
                    lang, own = texts.popitem()
                    shard[lang].add(own)
                size = 0
        if sum(t.words for t in shard.values()) > shard_words:
            yield shard
            shard = defaultdict(Text)
    batch = some = None  # room for what comes
    yield shard


def _table(lang: str, phrases: list[str | None], counts: np.ndarray, **more: int) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.full(len(phrases), x), pa.int64()) for x in more.values())], names=["lang", "phrase", "n", *more])


def mined(texts: DataFrame, totals: dict[str, int], support: int, least: int, most: int, bits: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, phrase, n, hidden, size``: what each shard finds of phrases of ``least`` to ``most`` words at its share of
    the support, how often it may hold a phrase it doesn't tell of, and the phrase's words. For each number of words a
    shard and language has a row without phrase, with the number of words in all, and one with an empty phrase, with the
    mark of the texts. ``totals`` are bytes of text by language; a language without gets all its phrases. ``bits``
    filters what phrases begin and end with that is shorter than ``least``."""
    sent = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admits = sent and passing(sent.value)
        for shard in _shards(batches, shard_words):
            while shard:
                lang, text = shard.popitem()
                own = _share(lang, text, totals, support)
                for size in range(least, most + 1):
                    yield _table(lang, [None, ""], np.array([text.words, text.mark & MARK]), hidden=own - 1, size=size)
                for phrases, counts in text.phrases(most, own, admits, _seed(lang), least):
                    if phrases:
                        yield _table(lang, phrases, counts, hidden=own - 1, size=1 + phrases[0].count(" "))

    return texts.mapInArrow(run, "lang string, phrase string, n long, hidden long, size long")


def _share(lang: str, text: Text, totals: dict[str, int], support: int) -> int:
    """The shares of all shards add up to one: a phrase is at or above its share of the support somewhere."""
    return max(1, -(-support * text.bytes // totals[lang])) if lang in totals else 1


def _seed(lang: str) -> int:
    return xxh3_64_intdigest(lang.encode())


def phrase_filter(candidates: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``lang, phrase`` with a power of two of bits: two bits a phrase."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([_seed(lang)], np.uint64)
                for word in phrase.encode().split(b" "):
                    h = mixed(h, np.array([xxh3_64_intdigest(word)], np.uint64))
                hashes.append(int(h[0]))
            places = np.concatenate(_places(np.array(hashes, np.uint64), bits)).astype(np.int64)
            slots, inverse = np.unique(places >> 6, return_inverse=True)
            values = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(values, inverse, np.uint64(1) << (places & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(values.view(np.int64))], names=["slot", "bits"])

    found = candidates.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)


def passing(content: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """Whether hashes pass a filter."""
    table = np.frombuffer(content, np.uint64)

    def admits(hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for place in _places(hashes, len(table) * 64):
            ok &= (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return ok

    return admits


def _counted(texts: DataFrame, totals: dict[str, int], support: int, bits: np.ndarray, most_words: int, shard_words: int, hidden: bool) -> DataFrame:
    """``lang, phrase, n`` of each shard for all phrases that pass the filter; with ``hidden`` only those below its share
    of the support, which ``mined`` doesn't tell of. Words and marks as there."""
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admits = passing(sent.value)
        for shard in _shards(batches, shard_words):
            while shard:
                lang, text = shard.popitem()
                own = _share(lang, text, totals, support) if hidden else None
                yield _table(lang, [None, ""], np.array([text.words, text.mark & MARK]))
                for phrases, counts in text.phrases(most_words, 1, admits, _seed(lang), below=own) if own != 1 else ():
                    yield _table(lang, phrases, counts)

    return texts.mapInArrow(run, "lang string, phrase string, n long")


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows."""
    both = one.withColumn("_sign", F.lit(1)).unionByName(other.withColumn("_sign", F.lit(-1)))
    return both.groupBy(*one.columns).agg(F.sum("_sign").alias("_sign")).where(F.col("_sign") != 0).isEmpty()


def frequent_phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", support: int = SUPPORT, most_words: int = MOST_WORDS, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all phrases of one to ``most_words`` words that occur ``support`` times in a language, and
    ``lang, n``, its words in all. ``shards``, where given, is the number of tasks that read the texts."""
    texts = docs.select(F.coalesce(docs[lang_column].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_column].cast("string").alias("text")).where("text <> ''")
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(MOST_LANGUAGES).collect()
    totals = {r.lang: r.bytes for r in sizes}
    # Fewer and larger shards have a larger share of the support; coalescing moves no rows.
    tasks = shards or max(LEAST_SHARDS, sum(totals.values()) // shard_bytes)
    dealt = texts.coalesce(tasks)
    # With a share of two or more a shard knows enough by itself to leave out what is rare: one pass for all lengths.
    at_once = tasks < support
    about, real = F.coalesce("phrase", F.lit("")) == "", F.coalesce("phrase", F.lit("")) != ""
    untold = F.col("all_hidden") - F.col("told")

    def found(least: int, most: int) -> DataFrame:
        bits = phrase_filter(candidates, n) if least > 1 else None
        local = mined(dealt, totals, support, least, most, bits, shard_words)
        return local.groupBy("size", "lang", "phrase").agg(F.sum("n").alias("f"), F.sum("hidden").alias("told"))

    def bounds(marks: DataFrame) -> DataFrame:
        return marks.where("phrase IS NULL").select("lang", F.col("told").alias("all_hidden"))

    def possible(rows: DataFrame, marks: DataFrame) -> DataFrame:
        return rows.join(bounds(marks), "lang").where(about | (F.col("f") + untold >= support)).select("size", "lang", "phrase", "f", "told", (real & (untold > 0)).alias("open"))

    first, candidates, ahead, n, any_open, repeated = None, None, None, 0, 0, True
    for size in range(1, most_words + 1):
        if first is None:
            level = stored(found(1, 1), "words")
            first = stored(level.where(about).drop("size"), "marks")
            level = stored(possible(level, first), "candidates")
        else:
            # What can't be frequent is never written: the bounds are those of the first pass, if it had these shards.
            if size == 2 or not at_once:
                ahead = stored(possible(found(size, most_words if at_once else size), first), "candidates")
            level = ahead.where(F.col("size") == size)
            if not _same(first, level.where(about).select(*first.columns)):
                repeated, level = False, stored(found(size, size), "mined")
                level = stored(possible(level, level.where(about)), "candidates")
        level = level.where(real)
        candidates = level if candidates is None else candidates.unionByName(level)
        more = level.agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
        n, any_open = n + more.n, any_open + more.open
        if not more.n:
            break
    words = first.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    if any_open:
        return _completed(candidates.select("lang", "phrase", "f"), first, dealt, totals, support, phrase_filter(candidates, n), most_words, shard_words, repeated), words
    return candidates.select("lang", "phrase", "f"), words


def _completed(candidates: DataFrame, first: DataFrame, dealt: DataFrame, totals: dict[str, int], support: int, bits: np.ndarray, most_words: int, shard_words: int, repeated: bool) -> DataFrame:
    """``lang, phrase, f`` of the candidates that have the support, with what shards hadn't told of them."""
    enough, real = F.col("f") >= support, F.coalesce("phrase", F.lit("")) != ""

    def counted(hidden: bool) -> DataFrame:
        return _counted(dealt, totals, support, bits, most_words, shard_words, hidden).withColumnRenamed("n", "f")

    if repeated:
        rows = stored(candidates.unionByName(counted(True)).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(~real | enough), "counted")
        if _same(first.select("lang", "phrase", "f"), rows.where(~real)):
            return rows.where(real)
    return stored(counted(False).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(real & enough), "counted")


def _big(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", support: int = SUPPORT, top: int = TOP, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to four words of each language.

    A phrase cut after its first words has the score floor(SCALE * a / (l + r)) by the counts of the two parts; its
    lowest-scoring cut counts, ties to the earliest. Phrases inside a longer one with ``COVERED`` percent of their count
    are left out. Order: score, count, then the phrase by its bytes. NULL languages are ``und``; NULL and empty texts
    have no words; every row counts, also where ids repeat; other columns aren't read. An empty table gives none.
    """
    counts, words = frequent_phrases(docs, text_column, lang_column, support, **options)
    parts = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    phrases = parts.where(F.size("w") > 1)
    cut = lambda first, length: F.array_join(F.slice("w", first, length), " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST(a AS decimal(20,0)) * CAST({SCALE} AS decimal(10,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    inner = parts.where(F.size("w") > 2).withColumn("length", F.explode(F.sequence(F.lit(2), F.size("w") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    covers = inner.select("lang", cut(F.col("first"), F.col("length")).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    covered = F.coalesce(_big(F.col("cover")) * 100 >= _big(F.col("a")) * COVERED, F.lit(False))
    left = worst.join(covers, ["lang", "phrase"], "left").where(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH low AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (SELECT lang, id, generate_subscripts(p, 1) AS piece, unnest(p) AS piece_text FROM (SELECT lang, id, regexp_split_to_array(text, '[.,;:!?
-
]') AS p FROM low)
), w AS (SELECT lang, id, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT lang, id, piece, regexp_extract_all(piece_text, '[^ 	]+') AS ws FROM pieces)
), g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id, piece ORDER BY i)
), said AS (
    SELECT lang, [w1] AS p FROM g UNION ALL SELECT lang, [w1, w2] FROM g WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, [w1, w2, w3] FROM g WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w1, w2, w3, w4] FROM g WHERE w4 IS NOT NULL
), f AS (SELECT lang, p, count(*) AS f FROM said GROUP BY 1, 2 HAVING count(*) >= 30
), size AS (SELECT lang, count(*) AS n FROM w GROUP BY 1
), cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]
), worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_ AS (SELECT lang, f, p[s:s + m - 1] AS p FROM (SELECT *, unnest(range(1, len(p) - m + 2)) AS s FROM (SELECT *, unnest(range(2, len(p))) AS m FROM f WHERE len(p) > 2))
), covers AS (SELECT lang, p, max(f) AS cover FROM inner_ GROUP BY 1, 2
), named AS (SELECT w.lang, array_to_string(w.p, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM worst w LEFT JOIN covers c ON c.lang = w.lang AND c.p = w.p WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named JOIN size USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
