"""Exact removal of long repeated byte strings, by suffix sorting at sampled positions.

Every string of ``length`` bytes has an anchor: the leftmost of its ``ANCHOR``-byte parts with the least hash. Equal
strings have equal anchors at equal places, so it is enough to sort the suffixes that begin at anchors, about one in
eighty bytes, to the right and to the left. The strings with one anchor are a context of a few hundred bytes.

1. Anchors are counted by hash. One that stands alone has no repeats.
2. Contexts whose bytes repeat as a whole are repeats as a whole; they are told by their hash, in counts only, so copies
   of any number cost one row per task.
3. What is left is compared by bytes within its hash: one context of each kind. Deep-shallow sorting orders the suffixes
   to the right of the anchor (multikey quicksort to ``SHALLOW`` bytes, blind tries for groups that agree so far) and,
   reversed, those to the left; common prefixes of neighbours give how far any two agree on either side. Two contexts
   that agree on ``length`` bytes together repeat there.
4. A hash with more than ``GROUP`` kinds of context is split first: by halves of the places that the anchor takes in a
   string, and by the bytes that all strings of such a half share. Contexts cut to a half are counted as in step 2 and
   compared as in step 3. At single places a context is one string, so that nothing is left to split.

Documents meet their spans by a join; removed bytes are cut and digested in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.storage import stored

LENGTH, ANCHOR, SHALLOW, GROUP = 200, 40, 16, 512
#: Bytes whose anchors are found at a time.
CHUNK = 1 << 18
SEED = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64)
#: Odd factors of the hash of 2, 4, ... bytes.
FACTORS = [int(x) | 1 for x in np.random.default_rng(13).integers(1 << 60, 1 << 62, 48, np.int64)]


def _mixed(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    h = left * np.uint64(FACTORS[k]) + right
    h ^= h >> np.uint64(29)
    h *= np.uint64(FACTORS[k + 20])
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of all parts of 2**k bytes; those of other lengths from parts that overlap."""

    def __init__(self, data: np.ndarray, most: int):
        self.by_power = [SEED[data]]
        while 2 << len(self.by_power) - 1 <= most and 2 << len(self.by_power) - 1 <= len(data):
            k = len(self.by_power)
            half, size = self.by_power[-1], 1 << k - 1
            self.by_power.append(_mixed(half[: len(data) - 2 * size + 1], half[size : len(data) - size + 1], k - 1))

    def fixed(self, size: int) -> np.ndarray:
        """Hash of ``size`` bytes from each place that has them."""
        k = size.bit_length() - 1
        part, n = self.by_power[k], len(self.by_power[0]) - size + 1
        return part[:n] if size == 1 << k else _mixed(part[:n], part[size - (1 << k) :][:n], k + 7)

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash of each part; sizes lie between the greatest power and four times that."""
        k = len(self.by_power) - 1
        part, room = self.by_power[k], size - (1 << k)
        h = part[start]
        for third in (1, 2, 3):
            h = _mixed(h, part[start + room * third // 3], k + 7 + third)
        return h + size.astype(np.uint64) * np.uint64(FACTORS[40])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value among ``width`` from each place that has them."""
    n, size = len(values), 1
    value, place = values, np.arange(n, dtype=np.int32)
    while 2 * size <= width:
        m = n - 2 * size + 1
        right = value[size : size + m] < value[:m]
        place = np.where(right, place[size : size + m], place[:m])
        value = np.where(right, value[size : size + m], value[:m])
        size *= 2
    m, gap = n - width + 1, width - size
    return np.where(value[gap : gap + m] < value[:m], place[gap : gap + m], place[:m]) if gap else place


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after the other in ``data`` (``ends``: of each): for every anchor the first byte of its
    context, the context's size, the anchor's place in it, its hash, and the context's hash."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk + length - 1]
        windows = len(part) - length + 1
        if windows <= 0:
            break
        hashes = Hashes(part, length)
        keys = hashes.fixed(anchor)
        place = _least(keys, length - anchor + 1)[:windows]
        start = np.arange(windows)
        end = ends[np.searchsorted(ends, start + at, "right")] - at
        inside = start + length <= end
        # Neighbouring strings with one anchor make a context; no context crosses texts.
        fresh = inside & np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]])
        last = inside & np.concatenate([(place[1:] != place[:-1]) | ~inside[1:], [True]])
        first, final = np.flatnonzero(fresh), np.flatnonzero(last)
        if not len(first):
            continue
        size, mid = final - first + length, place[first]
        found.append((first + at, size, mid - first, keys[mid].view(np.int64), hashes.of(first, size).view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


class BlindTrie:
    """Order of strings that agree on a long prefix: inner nodes know a depth and the byte there, not the bytes
    between; an insertion walks down blindly, compares once with the string it ends at, and goes in at their fork."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, k: int) -> None:
        own = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, dict):
            depth = node["depth"]
            byte = own[depth] if depth < len(own) else -1
            node = node["to"].get(byte) or next(iter(node["to"].values()))
        other = self.strings[node[0]]
        fork = common(own, other)
        mine, theirs = own[fork] if fork < len(own) else -1, other[fork] if fork < len(other) else -1
        if mine == theirs == -1:
            node.append(k)
            return
        node, above = self.root, None
        while isinstance(node, dict) and node["depth"] < fork:
            depth = node["depth"]
            above = (node["to"], own[depth] if depth < len(own) else -1)
            node = node["to"][above[1]]
        if isinstance(node, dict) and node["depth"] == fork:
            node["to"][mine] = [k]
            return
        new = {"depth": fork, "to": {theirs: node, mine: [k]}}
        if above is None:
            self.root = new
        else:
            above[0][above[1]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                stack += [node["to"][byte] for byte in sorted(node["to"], reverse=True)]
            elif node:
                out += node
        return out


def deep_shallow(strings: list[bytes], agreed: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The strings' order, and the common prefix of each with the one before (0 for the first). All agree on the first
    ``agreed`` bytes."""
    out: list[int] = []
    stack: list[tuple[list[int], int, bool]] = [(list(range(len(strings))), agreed, False)]
    while stack:
        some, depth, ended = stack.pop()
        if len(some) < 2 or ended:
            out += some
        elif depth >= agreed + shallow:
            trie = BlindTrie(strings)
            for k in some:
                trie.insert(k)
            out += trie.order()
        else:
            byte = [strings[k][depth] if depth < len(strings[k]) else -1 for k in some]
            pivot = sorted((byte[0], byte[len(some) // 2], byte[-1]))[1]
            less, same, more = [], [], []
            for k, b in zip(some, byte, strict=True):
                (less if b < pivot else more if b > pivot else same).append(k)
            stack += [(more, depth, False), (same, depth + 1, pivot == -1), (less, depth, False)]
    return out, [0, *(common(strings[a], strings[b]) for a, b in zip(out, out[1:], strict=False))]


def _agreement(strings: list[bytes], agreed: int) -> np.ndarray:
    """How many bytes any two of a bounded group have in common: least of the neighbours' between them in the order."""
    n = len(strings)
    order, lcp = deep_shallow(strings, agreed)
    sorted_matrix = np.zeros((n, n), np.int32)
    steps = np.array(lcp, np.int32)
    for i in range(n - 1):
        sorted_matrix[i, i + 1 :] = np.minimum.accumulate(steps[i + 1 :])
    sorted_matrix += sorted_matrix.T
    out = np.empty_like(sorted_matrix)
    out[np.ix_(order, order)] = sorted_matrix
    return out


def repeats(contexts: list[bytes], offsets: list[int], length: int, agreed: int) -> list[list[tuple[int, int]]]:
    """For each context of one anchor hash the parts (first byte, end) that another one repeats; the anchor is at the
    offset, and its ``agreed`` bytes are the same in all, unless hashes collide."""
    lefts, rights = [c[:o][::-1] for c, o in zip(contexts, offsets, strict=True)], [c[o:] for c, o in zip(contexts, offsets, strict=True)]
    if any(r[:agreed] != rights[0][:agreed] for r in rights):
        agreed = 0
    if len(contexts) == 2:
        left, right = common(*lefts), common(*rights)
        return [[(o - left, o + right)] if left + right >= length else [] for o in offsets]
    left, right = _agreement(lefts, 0), _agreement(rights, agreed)
    out = []
    for k, offset in enumerate(offsets):
        partners = np.flatnonzero(left[k] + right[k] >= length)
        out.append(sorted(set(zip((offset - left[k, partners]).tolist(), (offset + right[k, partners]).tolist(), strict=True))))
    return out


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """``rid, key, whole, place`` per anchor; place holds first byte << 20 | size << 10 | offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            if not len(texts):
                continue
            _, offsets, data = texts.buffers()
            bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            content = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
            ends = bounds[1:] - bounds[0]
            first, size, mid, key, whole = anchors(content, ends, length)
            owner = np.searchsorted(ends, first, "right")
            begin = first - np.concatenate([[0], ends])[owner]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rids[owner], key, whole, begin << 20 | size << 10 | mid)], names=["rid", "key", "whole", "place"])

    return docs.mapInArrow(run, "rid long, key long, whole long, place long")


def _compare(rows: DataFrame, length: int) -> DataFrame:
    """``rid, first, end`` of what repeats in groups of one key, each of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, int, bytes]] = []
        key = None

        def result() -> list[tuple[int, int, int]]:
            if len(group) < 2:
                return []
            parts = repeats([g[4] for g in group], [g[3] for g in group], length, ANCHOR)
            return [(rid, first + a, first + b) for (rid, n, first, _, _), own in zip(group, parts, strict=True) if n == 1 for a, b in own]

        def table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["rid", "first", "end"])

        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if k != key:
                    found += result()
                    key, group = k, []
                group.append(tuple(row))
            yield table(found)
        yield table(result())

    ordered = rows.select("key", "rid", "n", "first", "mid", "context").repartition("key").sortWithinPartitions("key", "rid", "first")
    return ordered.mapInArrow(run, "rid long, first long, end long")


def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts cut down to the strings whose anchor has its place in one interval of ``width``, under a key of the
    interval and of the bytes that all those strings share."""
    low = F.greatest(F.lit(0), F.col("mid") + length - F.octet_length("context"))
    cells = F.sequence(F.floor(low / width).cast("int"), F.floor(F.col("mid") / width).cast("int"))
    cut = rows.withColumn("cell", F.explode(cells)).withColumn("u", F.col("cell") * width)
    # Strings with the anchor at places u .. u + width - 1 lie between these bytes of the context.
    begin = F.greatest(F.lit(0), F.col("mid") - (F.col("u") + width - 1)).cast("int")
    end = F.least(F.octet_length("context"), F.col("mid") - F.col("u") + length).cast("int")
    core = F.substr("context", (F.col("mid") - F.col("u") + 1).cast("int"), F.lit(length + 1 - width))
    return cut.select(F.xxhash64("key", "u", F.lit(width), core).alias("key"), "rid", "n", (F.col("first") + begin).alias("first"), (F.col("mid") - begin).cast("int").alias("mid"), F.substr("context", begin + 1, end - begin).alias("context"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``rid, first, end`` (bytes; spans of one rid may overlap) for ``docs`` with ``rid, text``: every byte of a string of
    ``length`` bytes that also begins anywhere else."""
    found = _pieces(docs, length)
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    several = stored(found.join(keys.select("key", (F.col("low") == F.col("high")).alias("same")), "key"), "anchors")
    first, size, mid = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023))
    alike = several.where("same").select("rid", first.alias("first"), (first + size).alias("end"))
    mixed = several.where("NOT same")
    kinds = stored(mixed.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("one")), "contexts")
    copied = mixed.join(kinds.where("n > 1").select("key", "whole"), ["key", "whole"], "left_semi").select("rid", first.alias("first"), (first + size).alias("end"))
    # The bytes of one context of each kind: positions of a document go to its text, and leave with their bytes.
    wanted = kinds.select(F.col("one.rid").alias("rid"), F.struct("key", "n", F.col("one.place").alias("place")).alias("want")).groupBy("rid").agg(F.collect_list("want").alias("wants"))
    at = docs.select(F.col("rid"), F.col("text").cast("binary").alias("bytes")).join(wanted, "rid")

    def taken(w):
        begin, n, middle = F.shiftright(w["place"], 20), F.shiftright(w["place"], 10).bitwiseAND(F.lit(1023)), w["place"].bitwiseAND(F.lit(1023))
        return F.struct(w["key"].alias("key"), w["n"].alias("n"), begin.alias("first"), middle.cast("int").alias("mid"), F.substr(F.col("bytes"), (begin + 1).cast("int"), n.cast("int")).alias("context"))

    rows = stored(at.select("rid", F.explode(F.transform("wants", taken)).alias("c")).select("c.key", "rid", "c.n", "c.first", "c.mid", "c.context"), "bytes")
    parts = [alike, copied]
    width = 128
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
        parts.append(_compare(rows.join(sizes.where(F.col("kinds") <= group).select("key"), "key", "left_semi"), length))
        large = sizes.where(F.col("kinds") > group).select("key")
        if large.isEmpty():
            break
        # What is the same within a half is repeated as a whole, as in the second step; one of each kind goes on.
        halves = stored(_split(rows.join(large, "key", "left_semi"), width, length).withColumn("whole", F.xxhash64("context")), "halves")
        same = halves.groupBy("key", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "first", "mid", "context")).alias("one"))
        again = halves.join(same.where("n > 1").select("key", "whole"), ["key", "whole"], "left_semi").where("n = 1")
        parts.append(again.select("rid", "first", (F.col("first") + F.octet_length("context")).alias("end")))
        rows = stored(same.select("key", "one.rid", "n", "one.first", "one.mid", "one.context"), "bytes")
        width //= 2
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part.select(*(F.col(c).cast("long").alias(c) for c in ("rid", "first", "end"))))
    return spans


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``id_column, n_bytes, n_removed, n_spans, kept binary`` per row of ``docs``: the text as UTF-8 without each byte of a
    string of ``length`` bytes that also begins elsewhere, in any row.

    A NULL text counts as empty. Rows that repeat are repeats of each other and lose such strings; rows of one id may
    hold different texts. Other columns aren't read. An empty table gives none.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].alias("id"), text.alias("text"), F.xxhash64(docs[id_column], text).alias("rid"))
    spans = repeated_spans(rows.select("rid", "text"), length, group)
    # Ends of one document are kept as one number each: first << 32 | end.
    lists = spans.groupBy("rid").agg(F.collect_set(F.shiftleft("first", 32).bitwiseOR(F.col("end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for raw, own in zip(batch.column(1), batch.column(2), strict=True):
                content = raw.as_py().encode()
                out.append((len(content), *_cut(content, own.as_py() or [])))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(lists, "rid", "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_column)


def _cut(content: bytes, spans: list[int]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and what is left."""
    kept, at, runs, removed = [], 0, 0, 0
    end = -1
    for span in sorted(spans):
        a, b = span >> 32, span & 0xFFFFFFFF
        if a > end:
            kept.append(content[at:a])
            runs += 1
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    kept.append(content[at:])
    return removed, runs, b"".join(kept)


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
