"""Benchmark decontamination with an FM-index per shard of training text.

A worker reads its documents in shards. A word is looked up in the vocabulary of the benchmark; a run of known words
shorter than the shortest phrase can't hold one, so a shard's text is its longer runs, with a separator after each.
Over that text the shard builds an FM-index: suffix array by prefix doubling, Burrows-Wheeler transform, a wavelet
tree for ranks, and every eighth suffix position. All phrases are searched backward at once; the rows they end at are
walked to a sampled position, and the spans of words found are merged per document. Nothing is shuffled.

The phrases go to the workers by broadcast, whose size is checked: a benchmark with more words than ``phrase_words``
is searched in several passes over parts of its items, and the spans of the passes are merged by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.byte_bpe import text_blocks
from barloom.llm.storage import lean, own_columns, stored

FOUND = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))).add("items", T.ArrayType(T.StringType()))
#: Words of a phrase; text characters of a shard; words of items in one pass; distance of sampled suffixes.
WINDOW, SHARD_CHARS, PHRASE_WORDS, SAMPLED = 13, 4_000_000, 2_000_000, 8
ROW = "__row"
#: Fixed value: bytes 0-9, A-Z, a-z and those of characters beyond ASCII make words; A-Z are lower-cased.
FOLD = bytes((b | 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class WaveletTree:
    """Ranks over an integer sequence: level by level, the sequence ordered by its leading bits, with counts of ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        # starts[s]: how many values are below s; a node's first place on its level is starts[its first symbol].
        self.starts = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(values, minlength=1 << bits), out=self.starts[1:])
        self.ones: list[np.ndarray] = []
        for level in range(bits):
            bit = values >> (bits - 1 - level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            values = values[np.argsort(values >> (bits - 1 - level), kind="stable")]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        at = end
        for level in range(self.bits):
            shift = self.bits - level
            first = self.starts[symbol >> shift << shift]
            ones = self.ones[level][first + at] - self.ones[level][first]
            at = np.where(symbol >> (shift - 1) & 1, ones, at - ones)
        return at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, a shorter one before those it begins: prefix doubling."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - width)] = rank[width:] + 1
        key = rank * (max(n, int(rank.max(initial=0))) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width = width * 2
        if new[-1] == n - 1:
            return order


class FmIndex:
    """Words are symbols from 2; 1 ends a run, and 0 ends the text, so that it is least and stands there once."""

    def __init__(self, text: np.ndarray, bits: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.tree = WaveletTree(self.last, bits)
        self.n = len(text)
        kept = order % SAMPLED == 0
        self.kept, self.place, self.positions = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of each phrase; phrases are padded at the end. Known symbols only."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > step) & (low < high))
            symbol = phrases[on, step]
            first = self.tree.starts[symbol]
            low[on], high[on] = first + self.tree.rank(symbol, low[on]), first + self.tree.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, steps, going, row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        while len(going):
            here = self.kept[row]
            out[going[here]] = self.positions[self.place[row[here]]] + steps[going[here]]
            going, row = going[~here], row[~here]
            symbol = self.last[row]
            row = self.tree.starts[symbol] + self.tree.rank(symbol, row)
            steps[going] += 1
        return out


class Phrases:
    """The windows of all items, once each, with the items that hold them."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners = found.setdefault(tuple(ids[at : at + window]), set())
                if item is not None:
                    owners.add(str(item))
        self.owners = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(p) for p in found] or [0], np.int64)[: len(found)]
        self.symbols = np.array([(*p, *repeat(0, window - len(p))) for p in found], np.int64).reshape(len(found), window)
        self.shortest = int(self.lengths.min(initial=1 << 30))
        self.bits = (len(self.vocabulary) + 1).bit_length()


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of places that are inside."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def shard_hits(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text its number of words, the merged spans of hit words (end exclusive), and the items found."""
    # All words in one row as numbers, with an unknown one after each text; a text's words are let go with it.
    numbers = [np.fromiter(map(phrases.vocabulary.get, [*words_of(t), b""], repeat(0)), np.int32) for t in texts]
    counts = np.fromiter(map(len, numbers), np.int64, len(numbers)) - 1
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = [(n, [], []) for n in counts.tolist()]
    if not phrases.owners or not counts.sum():
        return out
    known = np.concatenate(numbers)
    del numbers
    begin, end = _runs(known > 0)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    sizes = end - begin + 1  # the separator too
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = known[np.arange(at[-1]) + np.repeat(begin - at[:-1], sizes)].astype(np.int64)
    text[at[1:] - 1] = 1
    index = FmIndex(text, phrases.bits)
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return out
    n = high[found] - low[found]
    which = np.repeat(found, n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
    place = index.locate(rows)
    run = np.searchsorted(at, place, "right") - 1
    word = begin[run] + place - at[run]  # in the row of all words
    first = np.concatenate([[0], np.cumsum(counts + 1)])
    owner = np.searchsorted(first, word, "right") - 1
    change = np.zeros(len(known) + 1, np.int32)
    np.add.at(change, word, 1)
    np.add.at(change, word + phrases.lengths[which], -1)
    for a, b in zip(*(x.tolist() for x in _runs(np.cumsum(change, out=change) > 0)), strict=True):
        k = int(np.searchsorted(first, a, "right")) - 1  # spans end before the unknown word between texts
        out[k][1].append((a - int(first[k]), b - int(first[k])))
    items: dict[int, set[str]] = {}
    for k, p in set(zip(owner.tolist(), which.tolist(), strict=True)):
        items.setdefault(k, set()).update(phrases.owners[p])
    for k, ids in items.items():
        out[k][2].extend(sorted(ids))
    return out


def _pass(docs: DataFrame, items: list, window: int, text_column: str) -> tuple[DataFrame, Broadcast]:
    """``docs`` with ``n_words, spans, items``, and the broadcast it reads."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for batch in batches:
            for at, texts in text_blocks(batch.column(place), SHARD_CHARS):
                n, spans, ids = zip(*shard_hits(texts, phrases), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(texts)).columns, pa.array(n, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in own] for own in spans], span), pa.array(ids, pa.list_(pa.string()))],
                    names=[*batch.schema.names, "n_words", "spans", "items"],
                )

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *FOUND.fields])), sent


def find_phrases(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    phrase_words: int = PHRASE_WORDS,
    carry: bool = False,
) -> DataFrame:
    """``id_column, n_words, spans, items`` per row of ``docs`` (with ``carry``: beside all its columns, of which those
    named like the three are replaced): the merged spans of words (end exclusive) inside an
    occurrence of a window of an item, and the ids (as text, sorted) of the items with such windows.

    A NULL or empty text has no words, an item without words no window; items without id hit words, but aren't among ``items``. Every row of
    ``docs`` is judged alone, also where ids repeat or are NULL, however many passes there are: beyond one, the rows
    are written with a key of their own, and each pass is written before the next part of the benchmark is sent.
    Other columns aren't read. An empty benchmark hits nothing.
    """
    items = benchmark.select(benchmark[item_column].cast("string").alias("item"), benchmark[item_text_column].cast("string").alias("text")).where("text IS NOT NULL")
    # A word takes two bytes with its gap at least: half the text bounds the words, and decides the passes.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n // 2
    passes = max(1, -(-size // phrase_words))
    rows = docs.drop(*FOUND.names) if carry else docs.select(id_column, text_column)
    if passes == 1:
        found = _pass(rows, [tuple(r) for r in items.collect()], window, text_column)[0]
        return found if carry else found.drop(text_column)
    rows = stored(rows.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    named = rows.select(ROW, F.col(text_column).alias("text"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    parts = []
    for k in range(passes):
        found, sent = _pass(named, [tuple(r) for r in items.where(part == k).collect()], window, "text")
        parts.append(stored(found.drop("text").where((F.size("spans") > 0) | F.lit(k == 0)), "pass"))
        sent.destroy()
    found = reduce(DataFrame.unionByName, parts)
    merged = found.groupBy(ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def joined(done, span):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]), grown).otherwise(F.concat(done, F.array(span)))

    spans = F.aggregate("all", empty, joined)
    merged = merged.select(ROW, "n_words", spans.alias("spans"), "items")
    return (rows if carry else rows.drop(text_column)).join(merged, ROW).drop(ROW)


def is_contaminated(one_in: int = 20) -> Column:
    """Of what ``find_phrases`` tells: a word is hit, and of ``one_in`` words one is hit at least."""
    return (n_hit() > 0) & (n_hit() * one_in >= F.col("n_words"))


def n_hit() -> Column:
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, **options) -> DataFrame:
    """``n_words, n_hit, n_items, items_sha256, contaminated, spans`` per document. The digest is of the item ids, sorted
    as text and joined by commas.

    Options and the rules for nulls, repeats and empty tables are those of ``find_phrases``.
    """
    found = find_phrases(docs, benchmark, **options)
    return found.select(
        found.columns[0],
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(one_in).alias("contaminated"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns, whatever their names."""
    text = options.pop("text_column", "text")
    packed = docs.select(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(own_columns(docs)) if docs.columns[k] != text), F.lit(0).alias("none")).alias("doc"), docs[text].alias("text"))
    kept = find_phrases(packed, benchmark, carry=True, **options).where(~is_contaminated(one_in))
    return kept.select(*(F.col("text").alias(name) if name == text else F.col(f"doc.c{k}").alias(name) for k, name in enumerate(docs.columns)))

