"""Spelling variants by k-d trees over letter counts.

A word is the vector of how often it holds each letter. A replaced letter takes one from a count and adds one to
another, a deleted one takes one from a count: near words differ by 2 or 1 in L1 distance.

1. Words of a length that one task can't hold are dealt out by the upper planes of a k-d tree: letters and counts that
   halve the words of that length best, taken from exact histograms. A word is a point of one cell, and a query of every
   cell of its own and the next shorter length that one edit can reach. An overfull cell is cut into blocks by a hash,
   and its queries go to each of them.
2. A block builds a k-d tree of its points. Queries go down it together, and a subtree is left where its box needs more
   than the edit's one letter less and one more. Points that are left are compared letter by letter.

A task gives one row for each word it found near words for: their number and the most frequent one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.storage import stored

MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
#: Letters of the points of a block, points of a leaf, queries that go down a tree together.
BLOCK_LETTERS, LEAF, TOGETHER = 262_144, 32, 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts from here on are one class of the histograms.
MOST_COUNTED = 8
SAME, LONGER = 1, 2


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int | None = None) -> DataFrame:
    """``word, n``: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, and how often they occur.

    With ``damage``, a run whose crc32 of ``<id>:<run>`` it divides loses the code point at crc32 modulo length (test
    data for variants); rows without id lose none. A NULL text has no words.
    """
    text = F.translate(docs[text_column].cast("string"), UPPER, LOWER)
    words = docs.select(docs[id_column].cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.withColumn("h", h).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


class LetterTree:
    """A k-d tree of words of one length.

    A count is kept in unary, a bit for each letter and number it reaches, so an L1 distance is the number of bits that
    differ, and a box is two masks: the bits that all of its points have, and those that some have.
    """

    def __init__(self, words: list[str]):
        self.points = _points(words)
        self.letters = np.unique(self.points)
        vectors = self._vectors(self.points)
        self.most = vectors.max(axis=0)
        self.bit_letter = np.repeat(np.arange(len(self.most)), self.most)
        self.bit_count = np.arange(len(self.bit_letter)) - np.repeat(np.cumsum(self.most) - self.most, self.most) + 1
        masks = self._masks(vectors)
        self.order, self.nodes = np.arange(len(words)), []
        self._grow(vectors, masks, 0, len(words))
        self.masks = [m[self.order] for m in masks]

    def _vectors(self, points: np.ndarray) -> np.ndarray:
        """Letter counts; the last column counts letters that no point of the tree has."""
        column = np.searchsorted(self.letters, points)
        column[(column == len(self.letters)) | (self.letters[np.minimum(column, len(self.letters) - 1)] != points)] = len(self.letters)
        width = len(self.letters) + 1
        flat = (np.arange(len(points))[:, None] * width + column).ravel()
        return np.bincount(flat, minlength=len(points) * width).reshape(len(points), width).astype(np.int32)

    def _masks(self, vectors: np.ndarray) -> list[np.ndarray]:
        """64 bits of every word in each array."""
        bits = np.packbits(vectors[:, self.bit_letter] >= self.bit_count, axis=1, bitorder="little")
        bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))))
        return list(np.ascontiguousarray(bits.view(np.uint64).T))

    def _grow(self, vectors: np.ndarray, masks: list[np.ndarray], start: int, end: int) -> int:
        own = self.order[start:end]
        common, some = [np.bitwise_and.reduce(m[own]) for m in masks], [np.bitwise_or.reduce(m[own]) for m in masks]
        place = len(self.nodes)
        self.nodes.append((common, some, start, end, -1, -1))
        if len(own) > LEAF and any(a != b for a, b in zip(common, some, strict=True)):
            counts = vectors[own]
            letter = int(counts.var(axis=0, dtype=np.float32).argmax())
            values = counts[:, letter]
            left = values < max(np.median(values), values.min() + 1)
            self.order[start:end] = np.concatenate([own[left], own[~left]])
            middle = start + int(left.sum())
            a, b = self._grow(vectors, masks, start, middle), self._grow(vectors, masks, middle, end)
            self.nodes[place] = (common, some, start, end, a, b)
        return place

    def near(self, words: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a point that one edit leads to. Queries have the points' length, or one letter more."""
        points = _points(words)
        vectors, up = self._vectors(points), 0 if longer else 1
        masks, over = self._masks(vectors), np.maximum(vectors - self.most, 0).sum(axis=1).astype(np.uint16)
        queries, found, stack = [], [], [(0, np.arange(len(words)))]
        while stack:
            node, asking = stack.pop()
            common, some, start, end, a, b = self.nodes[node]
            less, more = over[asking], np.zeros(len(asking), np.uint16)
            for mask, low, high in zip(masks, common, some, strict=True):
                own = mask[asking]
                less += np.bitwise_count(own & ~high)
                more += np.bitwise_count(low & ~own)
            asking = asking[(less <= 1) & (more <= up)]
            if not len(asking):
                continue
            if a >= 0:
                stack += [(a, asking), (b, asking)]
                continue
            apart = np.repeat(over[asking][:, None], end - start, axis=1)
            for mask, held in zip(masks, self.masks, strict=True):
                apart += np.bitwise_count(mask[asking][:, None] ^ held[start:end])
            q, p = np.nonzero(apart == (1 if longer else 2))
            queries.append(asking[q])
            found.append(self.order[start + p])
        if not queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, p = np.concatenate(queries), np.concatenate(found)
        ok = np.zeros(len(q), bool)
        step = max(1, 4_000_000 // points.shape[1])
        for k in range(0, len(q), step):
            ok[k : k + step] = self._one_edit(points[q[k : k + step]], self.points[p[k : k + step]], longer)
        return q[ok], p[ok]

    @staticmethod
    def _one_edit(query: np.ndarray, point: np.ndarray, longer: bool) -> np.ndarray:
        """The order of letters decides: one place differs, or all before and all after a deleted place agree."""
        if not longer:
            return (query != point).sum(axis=1) == 1
        before = np.logical_and.accumulate(query[:, :-1] == point, axis=1).sum(axis=1)
        after = np.logical_and.accumulate((query[:, 1:] == point)[:, ::-1], axis=1).sum(axis=1)
        return before + after >= point.shape[1]


def _planes(vocabulary: DataFrame, block_letters: int) -> dict[int, list[tuple[int, int]]]:
    """For each length with too many words the planes, a letter and a count, that halve it best. The driver gets a row
    for each letter and count of these lengths."""
    sizes = {r.length: r.n for r in vocabulary.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).where(F.col("n") * F.col("length") > block_letters).collect()}
    if not sizes:
        return {}
    letters = vocabulary.where(F.char_length("word").isin(list(sizes))).select(F.char_length("word").alias("length"), "word", F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''")
    often = F.char_length("word") - F.char_length(F.replace("word", "letter", F.lit("")))
    counts = letters.groupBy("length", "letter", F.least(often, F.lit(MOST_COUNTED)).alias("often")).agg(F.count("*").alias("n"))
    classes: dict[tuple[int, str], list[int]] = {}
    for r in counts.collect():
        classes.setdefault((r.length, r.letter), [0] * (MOST_COUNTED + 2))[r.often] = r.n
    ranked: dict[int, list[tuple[int, int, int]]] = {}
    for (length, letter), by in classes.items():
        above = [(abs(2 * sum(by[t:]) - sizes[length]), t) for t in range(1, MOST_COUNTED + 1)]
        ranked.setdefault(length, []).append((*min(above), ord(letter)))
    return {length: [(letter, t) for _, t, letter in sorted(own)[: math.ceil(math.log2(sizes[length] * length / block_letters))]] for length, own in ranked.items()}


def _cells(word: str, planes: list[tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """The word's cell, and the planes that one letter more or one less crosses."""
    cell, up, down = 0, [], []
    for k, (letter, least) in enumerate(planes):
        n = word.count(chr(letter))
        if n >= least:
            cell |= 1 << k
        if n == least - 1:
            up.append(1 << k)
        elif n == least:
            down.append(1 << k)
    return cell, up, down


def _routed(vocabulary: DataFrame, planes: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """``length, cell, side, word, n``: every word as a point (side 0) and as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length = len(word)
                cell, up, down = _cells(word, planes.get(length, []))
                out.append((length, cell, 0, word, n))
                for add in (0, *up):
                    out += [(length, (cell | add) & ~less, SAME, word, n) for less in (0, *down)]
                cell, _, down = _cells(word, planes.get(length - 1, []))
                out += [(length - 1, cell & ~less, LONGER, word, n) for less in (0, *down)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["length", "cell", "side", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "length int, cell long, side int, word string, n long")


class _Block:
    """The near words that a block finds: for each word their number and the best, by count and then by name."""

    def __init__(self):
        self.words: list[str] = []
        self.counts: list[int] = []
        self.tree: LetterTree | None = None
        self.asking: tuple[int, list[str], list[int]] = (0, [], [])
        self.found: dict[str, tuple[int, int, str]] = {}

    def _note(self, word: str, other: str, n: int) -> None:
        known, most, form = self.found.get(word, (0, 0, other))
        if n > most or (n == most and other < form):
            most, form = n, other
        self.found[word] = (known + 1, most, form)

    def flush(self) -> None:
        side, words, counts = self.asking
        if words and self.words:
            self.tree = self.tree or LetterTree(self.words)
            for q, p in zip(*map(np.ndarray.tolist, self.tree.near(words, side == LONGER)), strict=True):
                self._note(words[q], self.words[p], self.counts[p])
                if side == LONGER:
                    self._note(self.words[p], words[q], counts[q])
        self.asking = (0, [], [])

    def add(self, side: int, word: str, n: int) -> None:
        if not side:
            self.words.append(word)
            self.counts.append(n)
            return
        if side != self.asking[0] or len(self.asking[1]) >= max(1, min(TOGETHER, BLOCK_LETTERS // len(word))):
            self.flush()
            self.asking = (side, [], [])
        self.asking[1].append(word)
        self.asking[2].append(n)


def near_words(vocabulary: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``word, n_near, top``: for each word of ``vocabulary`` (``word``, distinct and not empty, and ``n``) with near words
    their number, and the most frequent one as ``top.word, top.n``; ties go to the first in code-point order."""
    planes = _planes(vocabulary, block_letters)
    routed = stored(_routed(vocabulary, planes), "routed")
    blocks = F.greatest(F.ceil(F.col("points") * F.col("length") / block_letters), F.lit(1)).cast("int")
    cells = routed.where("side = 0").groupBy("length", "cell").agg(F.count("*").alias("points")).select("length", "cell", blocks.alias("blocks"))
    placed = routed.join(cells, ["length", "cell"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("block", F.explode(F.when(F.col("side") == 0, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: dict[str, tuple[int, int, str]]) -> pa.RecordBatch:
            columns = [pa.array(list(found), pa.string()), *(pa.array([f[k] for f in found.values()], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
            return pa.RecordBatch.from_arrays(columns, names=["word", "near", "most", "form"])

        group, block = None, _Block()
        for batch in batches:
            for length, cell, number, side, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (length, cell, number):
                    block.flush()
                    yield table(block.found)
                    group, block = (length, cell, number), _Block()
                block.add(side, word, n)
                if len(block.found) > 100_000:
                    yield table(block.found)
                    block.found = {}
        block.flush()
        yield table(block.found)

    # The rows are few and costly: with a number given, they aren't coalesced into few tasks.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.select("length", "cell", "block", "side", "word", "n").repartition(tasks, "length", "cell", "block").sortWithinPartitions("length", "cell", "block", "side", "word")
    found = rows.mapInArrow(run, "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select("word", "n_near", F.struct(F.col("top.word").alias("word"), (-F.col("top.less")).alias("n")).alias("top"))


def _followed(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` of words with a form. Counts double at each step, so a chain has no more than log2(most) steps, and
    each round follows twice as many."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(0, (max(1, most).bit_length()).bit_length())):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("then"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "roots")
    return roots


def variants(vocabulary: DataFrame, factor: int = 2, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` per word of ``vocabulary`` (``word, n``; other columns aren't read).

    Near words differ by one inserted, deleted or replaced code point. The form is the near word of largest n, if that
    is ``factor`` times the word's n at least, and the root is where forms lead. Rows that repeat a word are added up;
    NULL and empty words and NULL counts are left out. An empty table gives none.
    """
    rows = vocabulary.select(vocabulary["word"].cast("string").alias("word"), vocabulary["n"].cast("long").alias("n")).where("word <> '' AND n IS NOT NULL")
    words = stored(rows.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    known: Column = F.col("top.n") >= factor * F.col("n")
    judged = words.join(near_words(words, block_letters), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("top.word")).alias("form"), F.when(known, F.col("top.n")).alias("form_n"))
    judged = stored(judged, "variants")
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    most = judged.agg(F.max("form_n").alias("n")).first().n or 0
    roots = _followed(judged.where("form IS NOT NULL"), most)
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """``variants`` of the words of ``docs`` with ``min_length`` code points and ``min_count`` occurrences at least. See
    ``word_counts`` for what a word is; rows that repeat count each time."""
    counts = word_counts(docs, id_column, text_column, damage)
    return variants(counts.where((F.char_length("word") >= min_length) & (F.col("n") >= min_count)))


#: Fixed values of the checksum: the reversed polynomial, and the table's 256 values made from it.
_CRC = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
#: A letter beyond a-z is one byte in the twin's distance.
_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = UPPER + "0123456789" + "!#$%&()*+,-./:;<=>?@[]^_`{|}"
SQL = f"""
WITH RECURSIVE tab AS (SELECT {_CRC} AS tab
), runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), once AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2
), hexed AS (SELECT *, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM once
), hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM hexed, tab
), cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed
), v AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_WIDE}', '{_BYTES}') AS k, length(word) AS len FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON b.len BETWEEN a.len - 1 AND a.len + 1 AND levenshtein(a.k, b.k) = 1
), best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'word': near}}) AS top FROM pairs GROUP BY 1
), judged AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.less >= 2 * n THEN top.word END AS form, CASE WHEN -top.less >= 2 * n THEN -top.less END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (SELECT word, word AS here, 0 AS step FROM judged UNION ALL SELECT c.word, j.form, step + 1 FROM chain c JOIN judged j ON j.word = c.here WHERE j.form IS NOT NULL
)
SELECT judged.*, (SELECT arg_max(here, step) FROM chain WHERE chain.word = judged.word) AS root FROM judged
"""
