"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is split by the tokenizer's pattern. Each piece starts as single bytes; a segment tree over its byte
positions holds, at every node, the least ``rank << bits | position`` of the pairs below it, so its root is the
leftmost pair of minimum rank. A merge changes three leaves (the merged position, its left neighbour, the swallowed
position) and repairs their paths to the root.

Pieces of at most ``WIDE`` bytes are merged many at a time, one tree per row of a matrix; longer ones one by one.
The result of a piece is kept in a bounded cache of the worker. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.storage import lean

WIDE = 64
#: Words and pieces whose results a worker keeps (some 100 MB), characters split and pieces merged at a time.
CACHED, BLOCK_CHARS, TOGETHER = 300_000, 2_000_000, 8_192
#: The vocabulary goes to the workers by broadcast; a larger file is refused.
MOST_VOCABULARY_BYTES = 64 << 20
NONE = np.int32(2**31 - 1)

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 text and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if rank}


class ByteBpe:
    """The merges of one rank table. Ids are ranks; every single byte must have one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: token for token, i in ranks.items()}
        if max(ranks.values()) >> 23:
            raise ValueError("ranks must be below 2**23")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Every way to cut a token into two tokens: (left << 32 | right) -> the token's rank.
        pairs = {
            ranks[token[:cut]] << 32 | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.pairs = pairs
        keys = np.array(sorted(pairs) or [0], np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs.get(k, 0) for k in keys.tolist()], np.int32)
        if not pairs:
            self.pair_keys[:] = -1

    def encode(self, text: str | None) -> list[int]:
        pieces = self.split(text or "")
        known = dict(zip(distinct := list(dict.fromkeys(pieces)), self.encode_pieces([p.encode() for p in distinct]), strict=True))
        return [i for p in pieces for i in known[p]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = [whole]
            elif len(piece) > WIDE:
                out[k] = self._merge_one(piece)
            else:
                by_size.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(k)
        for size, rows in by_size.items():
            for at in range(0, len(rows), TOGETHER):
                for k, ids in zip(part := rows[at : at + TOGETHER], self._merge_many([pieces[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, NONE where it doesn't; ids below 0 stand for no token."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def _merge_many(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """One tree per row: node 1 is the root, the leaf of position i is node size + i."""
        n, bits = len(pieces), size.bit_length()
        lengths = np.fromiter(map(len, pieces), np.int32, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        column = np.arange(size, dtype=np.int32)
        inside = column < lengths[:, None]
        # Column size is a place for what lies beyond either end: no token.
        token = np.full((n, size + 1), -1, np.int32)
        token[:, :size] = np.where(inside, self.byte_ids[raw], -1)
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (n, size + 1))
        after = np.where(after >= lengths[:, None], np.int32(size), after)
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
        before[:, 0] = size
        tree = np.full((n, 2 * size), NONE, np.int32)
        rank = self._ranks_of(token[:, :-1], token[:, 1:])
        tree[:, size:] = np.where(rank < NONE, rank << bits | column, NONE)
        for level in range(size.bit_length() - 2, -1, -1):
            first = 1 << level
            tree[:, first : 2 * first] = tree[:, 2 * first : 4 * first].reshape(n, first, 2).min(axis=2)
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at = root & (1 << bits) - 1
            gone = after[row, at]
            beyond, ahead = after[row, gone], before[row, at]
            token[row, at], token[row, gone] = root >> bits, -1
            after[row, at], before[row, beyond] = beyond, at
            right, left = self._ranks_of(token[row, at], token[row, beyond]), self._ranks_of(token[row, ahead], token[row, at])
            tree[row, size + gone] = NONE
            tree[row, size + at] = np.where(right < NONE, right << bits | at, NONE)
            edge = ahead == size  # nothing ahead: repair the merged leaf's path once more instead
            ahead = np.where(edge, at, ahead)
            tree[row, size + ahead] = np.where(edge, tree[row, size + at], np.where(left < NONE, left << bits | ahead, NONE))
            rows, node = np.concatenate([row, row, row]), np.concatenate([at, gone, ahead]) + size
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] < NONE]
        live = token[:, :size] >= 0
        flat, ends = token[:, :size][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_one(self, piece: bytes) -> list[int]:
        """The same tree in plain lists, for a long piece."""
        n, size = len(piece), 1 << (len(piece) - 1).bit_length()
        none, pairs = (1 << 62, -1), self.pairs
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        tree = [none] * (2 * size)

        def leaf(i: int) -> tuple[int, int]:
            rank = pairs.get(token[i] << 32 | token[after[i]]) if after[i] >= 0 else None
            return none if rank is None else (rank, i)

        tree[size : size + n] = map(leaf, range(n))
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] is not none and tree[1] != none:
            rank, at = tree[1]
            gone = after[at]
            token[at], after[at] = rank, after[gone]
            if after[gone] >= 0:
                before[after[gone]] = at
            token[gone] = -1
            for i, value in ((gone, none), (at, leaf(at)), (before[at], leaf(before[at]) if before[at] >= 0 else none)):
                if i < 0:
                    continue
                node = size + i
                tree[node] = value
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least and value is not least:
                        break
                    tree[node] = least
        return [t for t in token if t >= 0]


class Digests:
    """Token counts and digests of texts, with a bounded cache of words and pieces.

    A space before a character that isn't white space always begins a piece, so a text without other spaces is cut
    before its spaces, and what a word encodes to is looked up whole.
    """

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.known = bpe, {}
        self.ragged = re.compile(r" (?:\s|\Z)|\0").search

    def _cut(self, text: str | None) -> list[str]:
        if not text or self.ragged(text):
            return self.bpe.split(text or "")
        words = text.replace(" ", "\0 ").split("\0")
        return words if words[0] else words[1:]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        cut, known = list(map(self._cut, texts)), self.known
        if len(known) > CACHED:
            known.clear()
        self._learn(list({w for own in cut for w in own if w not in known}))
        out = []
        for own in cut:
            parts = list(map(known.__getitem__, own))
            joined = ",".join([ids for ids, _ in parts])
            out.append((joined.count(",") + bool(joined), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(b"".join([decoded for _, decoded in parts])).hexdigest()))
        return out

    def _learn(self, words: list[str]) -> None:
        """Joined ids and decoded bytes of each word."""
        known, rows = self.known, list(map(self.bpe.split, words))
        pieces = list({p for row in rows for p in row if p not in known})
        for at in range(0, len(pieces), 50_000):
            part = pieces[at : at + 50_000]
            for piece, ids in zip(part, self.bpe.encode_pieces([p.encode() for p in part]), strict=True):
                known[piece] = (",".join(map(str, ids)), self.bpe.decode(ids))
        for word, row in zip(words, rows, strict=True):
            if len(row) > 1:
                parts = [known[p] for p in row]
                known[word] = (",".join([ids for ids, _ in parts]), b"".join([decoded for _, decoded in parts]))


def blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` characters; a longer text stands alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, k
            start, size = k, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def text_blocks(column: pa.Array, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """The same ranges of a column, one after the other: the place of the first text, and the texts."""
    start, texts, size = 0, [], 0
    for k, value in enumerate(column):
        text = value.as_py()
        if size and size + len(text or "") > most:
            yield start, texts
            start, texts, size = k, [], 0
        texts.append(text)
        size += len(text or "")
    if texts:
        yield start, texts


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        content = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(content)


def token_digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs``: the text encoded by the ranks in
    ``path``, and the ids decoded again.

    A NULL text counts as empty: no tokens, and the digest of nothing. Rows that repeat give rows that repeat;
    other columns, whatever their names, are not read. An empty table gives none.
    """
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(ByteBpe(read_ranks(vocabulary.value), pattern))
        for batch in batches:
            for at, texts in text_blocks(batch.column(1)):
                n, ids, decoded = zip(*digests(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}").withColumnRenamed("id", id_column)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, ids array<int>`` per row of ``docs``; the rules of ``token_digests`` hold."""
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(read_ranks(vocabulary.value), pattern)
        for batch in batches:
            for at, texts in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(list(map(bpe.encode, texts)), pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_column)


def decode_ids(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column, bytes binary`` per row; NULL ids give no bytes, and an unknown id raises an error."""
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: token for token, i in read_ranks(vocabulary.value).items()}
        for batch in batches:
            decoded = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["id", "bytes"])

    rows = encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_column)
