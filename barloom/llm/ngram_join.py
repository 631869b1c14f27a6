"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of hashed word shingles. Those with the same set are one kind, and only kinds are compared.

1. Each kind has ``BANDS * ROWS`` MinHash values of 16 bits; kinds that agree on a whole band meet in its bucket. At the
   threshold of 0.8 a pair misses all bands with a chance of 5 in 100 million.
2. Buckets are cut into blocks of a bounded size, and blocks meet in pairs, so no bucket is held by one task. A pair
   is looked at in its first common band only. Its values are compared in steps; after each step the posterior
   probability (uniform prior) that its similarity reaches the threshold is compared with ``TOLERANCE``, and the pair is
   dropped below it. Only survivors leave the task.
3. Survivors are verified exactly: the shingle sets of a block meet in one task, once each. A block returns one row per
   kind, with the number of documents that its links add and the least id they connect it with.

No plan step has a row per pair or per copy: sums of the rows give the links of every document, and components of what
is connected are the classes. Explicit pairs of kinds are given on request.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.decontaminate import FOLD
from barloom.llm.storage import fresh, lean, own_columns, stored

WORDS, THRESHOLD, TOLERANCE, BANDS, ROWS, STEP, BLOCK = 5, 0.8, 1e-9, 32, 4, 16, 256
_RNG = np.random.default_rng(17)
LETTERS = _RNG.integers(1 << 61, 1 << 62, 256).astype(np.uint64)
BASE = int(_RNG.integers(1 << 61, 1 << 62)) | 5
FACTORS = (_RNG.integers(1 << 61, 1 << 62, BANDS * ROWS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as far as a text needs them."""

    def __init__(self):
        self.up, self.down = self._until(1 << 16)

    @staticmethod
    def _until(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        return out[0], out[1]

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = self._until(1 << n.bit_length())


def shingles(text: str | None, powers: Powers, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; of all words where there are fewer."""
    own = text.encode().translate(FOLD).split() if text else []
    if not own:
        return np.zeros(0, np.uint64)
    content = np.frombuffer(b" ".join(own), np.uint8)
    powers.reach(len(content) + 1)
    sums = np.zeros(len(content) + 1, np.uint64)
    np.cumsum(LETTERS[content] * powers.up[: len(content)], out=sums[1:])
    gaps = np.flatnonzero(content == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(content)]])
    n = max(1, len(own) - words + 1)
    start, end = starts[:n], ends[min(words, len(own)) - 1 :][:n]
    h = (sums[end] - sums[start]) * powers.down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minhashes(values: np.ndarray) -> bytes:
    """16 bits of the least value under each of the hash functions."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(least, (values[at : at + 512, None] * FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint16).tobytes()


def least_matches(threshold: float, tolerance: float, most: int, step: int = STEP) -> list[int]:
    """For each number of compared values the least number of equal ones that keeps a pair: the posterior of a uniform
    prior, a Beta distribution, still gives similarities from the threshold a probability of ``tolerance``."""
    out = []
    for m in range(step, most + 1, step):
        # P(J >= t | k of m) is the chance of at most k successes among m + 1 draws with probability t.
        chance, k = 0.0, -1
        while chance < tolerance:
            k += 1
            chance += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def _kinds(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            kinds, signatures = [], []
            for text in batch.column(1):
                values = shingles(text.as_py(), powers, words)
                kinds.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                signatures.append(minhashes(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.binary()), pa.array(signatures, pa.binary())], names=["id", "kind", "signature"])

    return docs.mapInArrow(lean(run), f"id {docs.schema['id'].dataType.simpleString()}, kind binary, signature binary")


def _survivors(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``key, left, right, id, partners``: for each kind of a block the later ones that no comparison drops, for those
    that have or are a partner. Rows of ``blocks`` are ``key, left, right, band, side, id, signature``."""
    floors = least_matches(threshold, tolerance, BANDS * ROWS)

    def pairs(group: list[tuple]) -> list[tuple]:
        band, one = group[0][0], group[0][2] == group[0][3]
        values = np.frombuffer(b"".join(g[6] for g in group), np.uint16).reshape(len(group), BANDS, ROWS)
        flat, ids, side = values.reshape(len(group), -1), [g[5] for g in group], np.array([g[4] for g in group])
        partners: list[list[int]] = []
        for k in range(len(group)):
            others = np.arange(k + 1, len(group))
            if not one:
                others = others[side[others] != side[k]]
            if band and len(others):
                earlier = (values[others, :band] == values[k, :band]).all(axis=2).any(axis=1)
                others = others[~earlier]
            matches = np.zeros(len(others), np.int64)
            for step, floor in enumerate(floors):
                if not len(others):
                    break
                part = slice(step * STEP, (step + 1) * STEP)
                matches += (flat[others, part] == flat[k, part]).sum(axis=1)
                keep = matches >= floor
                others, matches = others[keep], matches[keep]
            partners.append(others.tolist())
        met = {k for k, own in enumerate(partners) if own} | {o for own in partners for o in own}
        return [(*group[0][1:4], ids[k], [ids[o] for o in partners[k]]) for k in sorted(met)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        kind = pa.int64()

        def table(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), kind, pa.list_(kind)]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=["key", "left", "right", "id", "partners"])

        for batch in batches:
            kind = batch.column(5).type
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if group and row[1:4] != group[0][1:4]:
                    found += pairs(group) if len(group) > 1 else []
                    group = []
                group.append(row)
            yield table(found)
        if len(group) > 1:
            yield table(pairs(group))

    kind = blocks.schema["id"].dataType.simpleString()
    rows = blocks.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "id").select("band", "key", "left", "right", "side", "id", "signature")
    return rows.mapInArrow(lean(run), f"key long, left int, right int, id {kind}, partners array<{kind}>")


def _sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), powers, words).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    # The ids asked for grow with the documents: the join is a sort-merge at every size, never a broadcast.
    return docs.join(asked.hint("merge"), "id", "left_semi").mapInArrow(lean(sets), f"id {kind}, shingles binary").dropDuplicates(["id"])


def similarity(p: np.ndarray, q: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common / (len(p) + len(q) - common)


def _verified(hits: DataFrame, held: DataFrame, threshold: float, explicit: bool) -> DataFrame:
    """Of each block, where the sets of its kinds meet once: ``id, others, low``, the documents of the kinds that an id is
    linked with and the least id that links of the block connect it with; ``explicit``: the links, ``a, b, similarity``."""

    def links(group: list[tuple]) -> list[tuple]:
        at = {g[3]: k for k, g in enumerate(group)}
        values = [np.frombuffer(g[6], np.uint64) for g in group]
        for k, g in enumerate(group):
            for o in map(at.__getitem__, g[4]):
                if min(len(values[k]), len(values[o])) >= threshold * max(len(values[k]), len(values[o])) and (found := similarity(values[k], values[o])) >= threshold:
                    yield k, o, found

    def summed(group: list[tuple]) -> list[tuple]:
        others, top = [0] * len(group), list(range(len(group)))

        def root(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for k, o, _ in links(group):
            others[k] += group[o][5]
            others[o] += group[k][5]
            top[root(k)] = root(o)
        low: dict[int, object] = {}
        for k, g in enumerate(group):
            low[root(k)] = min(low.get(root(k), g[3]), g[3])
        return [(g[3], others[k], low[root(k)]) for k, g in enumerate(group) if others[k]]

    def listed(group: list[tuple]) -> list[tuple]:
        return [(*sorted((group[k][3], group[o][3])), found) for k, o, found in links(group)]

    names = ["a", "b", "similarity"] if explicit else ["id", "others", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        kind = pa.int64()

        def table(found: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, kind, pa.float64()] if explicit else [kind, pa.int64(), kind]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            kind = batch.column(3).type
            found: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += listed(group) if explicit else summed(group)
                    group = []
                group.append(row)
            yield table(found)
        if group:
            yield table(listed(group) if explicit else summed(group))

    kind = hits.schema["id"].dataType.simpleString()
    rows = hits.join(held, "id").select("key", "left", "right", "id", "partners", "n", "shingles").repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "id")
    return rows.mapInArrow(lean(run), f"a {kind}, b {kind}, similarity double" if explicit else f"id {kind}, others long, low {kind}")


def link_kinds(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, words: int = WORDS, block: int = BLOCK, explicit: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, rep`` (NULL for documents without a word), and what ``_verified`` tells of the representatives, the
    least ids of the kinds: sums for each, or with ``explicit`` every link between two.

    NULL and empty texts have no words and no links. Ids should be unique: rows that repeat an id count once. Rows
    without id take no part. Other columns aren't read.
    """
    rows = docs.where(docs[id_column].isNotNull()).select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    signed = stored(_kinds(rows, words), "kinds")
    kinds = stored(signed.where("kind IS NOT NULL").groupBy("kind").agg(F.min(F.struct("id", "signature")).alias("one")).select("kind", "one.*"), "representatives")
    members = stored(signed.select("id", "kind").dropDuplicates(["id"]).join(kinds.select("kind", F.col("id").alias("rep")), "kind", "left").select("id", "rep"), "members")

    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substr(F.col("signature"), b * width + 1, F.lit(width))).alias("key")))
    buckets = kinds.select("id", F.explode(bands).alias("x")).select("id", "x.band", "x.key")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / block).cast("int")
    met = buckets.join(sizes, "key").withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = met.select("key", F.least("cell", "other").alias("left"), F.greatest("cell", "other").alias("right"), "band", F.when(F.col("cell") == F.col("other"), F.lit(0)).otherwise(F.when(F.col("cell") < F.col("other"), F.lit(1)).otherwise(F.lit(2))).alias("side"), "id")
    hits = stored(_survivors(cut.join(kinds.select("id", "signature"), "id"), threshold, tolerance), "hits")
    counts = members.where("rep IS NOT NULL").groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("n"))
    held = stored(_sets(rows, hits.select("id").distinct(), words).join(counts, "id"), "sets")
    return members, stored(_verified(hits, held, threshold, explicit), "links")


def components(links: DataFrame) -> DataFrame:
    """``id, class`` for every id with a link: the least id that links reach. Labels go to neighbours and are then
    followed, until none changes."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("now"))
        jump = lower.select(F.col("id").alias("now"), F.col("now").alias("then"))
        new = stored(lower.join(jump, "now", "left").select("id", "was", F.coalesce(F.least("now", "then"), F.col("now")).alias("class")), "labels")
        labels = new.select("id", "class")
        if new.where("class <> was").isEmpty():
            return labels


def row_duplicates(rows: DataFrame, id_column: str = "row", text_column: str = "text", **options) -> DataFrame:
    """``id_column, class_id, kind_id, n_links`` per row of ``rows``, whose ids differ: the least id of its class (rows that
    links connect), the least id with the same shingles, and how many other rows reach the threshold with it. Rows
    without a word are alone."""
    members, found = link_kinds(rows, id_column, text_column, **options)
    sizes = members.where("rep IS NOT NULL").groupBy("rep").agg(F.count("*").alias("n"))
    linked = found.groupBy(F.col("id").alias("rep")).agg(F.sum("others").alias("others"))
    edges = found.where("low <> id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    facts = sizes.join(linked, "rep", "left").join(components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    facts = facts.select("rep", F.coalesce("class", "rep").alias("class"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(facts, "rep", "left").select(F.col("id").alias(id_column), F.coalesce("class", "id").alias("class_id"), F.coalesce("rep", "id").alias("kind_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``id_column, class_id, kind_id, n_links`` per row with an id: the least id of its class (documents that links
    connect), the least id with the same shingles, and how many other documents reach the threshold with it.

    Rows are compared by a stored number of their own, so every row of a repeated id is a document with its own text and
    gets a row. Rows without id take no part; documents without a word are alone. Other columns aren't read. An empty
    table gives none.
    """
    rows = docs.where(docs[id_column].isNotNull()).select(F.monotonically_increasing_id().alias("row"), docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    rows = stored(rows, "rows")
    found = row_duplicates(rows.select("row", "text"), **options).join(rows.select("row", "id"), "row")
    kinds = found.groupBy("class_id", "kind_id").agg(F.min("id").alias("kind"))
    classes = kinds.groupBy("class_id").agg(F.min("kind").alias("class"))
    named = found.join(kinds, ["class_id", "kind_id"]).join(classes, "class_id")
    return named.select(F.col("id").alias(id_column), F.col("class").alias("class_id"), F.col("kind").alias("kind_id"), "n_links")


def one_of_each(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """Of each class of near duplicates one row of ``docs``, with all its columns; rows that repeat, and those without id,
    are documents like others. Rows without a word all stay."""
    (row,) = fresh(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    dropped = row_duplicates(rows.select(F.col(row).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text")), **options).where("class_id <> row").select(F.col("row").alias(row))
    return rows.join(dropped, row, "left_anti").select(*own_columns(docs))
