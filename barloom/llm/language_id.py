"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram binds the vectors of its letters,
each rotated by its place, by multiplication; a text bundles the vectors of its n-grams by addition, and a language
the texts it is learned from, each scaled to length 1. A text gets the language whose prototype it has the greatest
cosine with.

Texts are lower-cased; every run of other characters than letters counts as one gap, also at both ends. Bundling
counts the distinct n-grams of a text first, so that each vector is added once, weighted. Vectors of n-grams are kept
in a bounded matrix of bits per worker.

Learning reads a bounded sample of the labelled rows (``train_rows`` of them are expected, chosen by a hash of the id)
and adds bundles by language in Spark; the driver receives one prototype per language and dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.storage import fresh, lean, own_columns

DIMENSIONS, NGRAM, TRAIN_ROWS, MOST_LANGUAGES, UNKNOWN = 1024, 3, 20_000, 1000, "und"
#: N-gram vectors that a worker keeps (8 MB at 1,024 dimensions), and n-grams added at a time.
KEPT, STEP = 65_536, 2_048
GAP = 0x20


@cache
def _letters() -> np.ndarray:
    """Code point -> itself where it is a letter, else a gap."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, points, np.uint32(GAP))


def letters_of(text: str | None) -> np.ndarray:
    """Lower-case letters with single gaps between words and at both ends; empty where there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.concatenate([[GAP], _letters()[points], [GAP]]).astype(np.int64)
    kept = kept[np.concatenate([[True], (kept[1:] != GAP) | (kept[:-1] != GAP)])]
    return kept if len(kept) > 1 else kept[:0]


class Space:
    """Hypervectors of n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = NGRAM):
        if not 1 <= n <= 3:
            raise ValueError("an n-gram has one to three letters")
        self.dimensions, self.n = dimensions, n
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.matrix = np.empty((KEPT, -(-dimensions // 8)), np.uint8)

    def _letter(self, point: int) -> np.ndarray:
        if (vector := self.letter.get(point)) is None:
            if len(self.letter) >= KEPT:
                self.letter.clear()
            vector = self.letter[point] = np.random.default_rng([7, point]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return vector

    def _vector(self, gram: int) -> np.ndarray:
        vector = np.ones(self.dimensions, np.int8)
        for place in range(self.n):
            vector = vector * np.roll(self._letter(gram >> 21 * place & 0x1FFFFF), place)
        return vector

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector, scaled to length 1; None where it has no letter."""
        letters = letters_of(text)
        if not len(letters):
            return None
        last = max(1, len(letters) - self.n + 1)
        keys = np.zeros(last, np.int64)
        for place in range(self.n):
            part = letters[self.n - 1 - place :][:last]
            keys[: len(part)] |= part << 21 * place
        grams, counts = np.unique(keys, return_counts=True)
        total = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(grams), STEP):
            some = grams[at : at + STEP].tolist()
            if len(self.row) + len(some) > KEPT:
                self.row.clear()
            for gram in some:
                if gram not in self.row:
                    self.matrix[len(self.row)] = np.packbits(self._vector(gram) > 0)
                    self.row[gram] = len(self.row)
            # A bit b stands for 2 * b - 1.
            rows = np.unpackbits(self.matrix[list(map(self.row.__getitem__, some))], axis=1, count=self.dimensions)
            own = counts[at : at + STEP].astype(np.float32)
            total += 2 * (own @ rows.astype(np.float32)) - own.sum()
        length = float(np.sqrt(total @ total))
        return total / length if length else total


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", dimensions: int = DIMENSIONS, n: int = NGRAM) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and their prototypes of length 1. Rows without language or letter teach nothing."""
    rows = docs.select(docs[lang_column].cast("string").alias("lang"), docs[text_column].cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, n), {}
        for batch in batches:
            for lang, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if (vector := space.bundle(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
            if len(sums) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "bundle"])

    parts = rows.mapInArrow(lean(bundles), "lang string, bundle array<double>").select("lang", F.posexplode("bundle").alias("place", "value"))
    # Values are rounded so that the order of addition can't decide a tie; the digits dropped are noise.
    sums = parts.groupBy("lang", "place").agg(F.round(F.sum("value"), 6).alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("bundle"))
    found = sorted((r.lang, [x.value for x in r.bundle]) for r in sums.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    prototypes = np.array([v for _, v in found], np.float64).reshape(len(found), dimensions)
    return [lang for lang, _ in found], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def sampled(docs: DataFrame, id_column: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs`` by a hash of the id, all where there are no more."""
    n = docs.select(id_column).count()
    if n <= rows:
        return docs
    buckets = 1 << 30
    return docs.where(F.pmod(F.xxhash64(docs[id_column]), F.lit(buckets)) < rows * buckets // n)


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text", n: int = NGRAM) -> DataFrame:
    """``docs`` with ``lang_pred, score``: the language of the greatest cosine and that cosine, 0 at least. Equal cosines
    go to the first language by name.

    A NULL or empty text and one without a letter get ``und`` and 0, as does everything where no language was
    learned. Rows that repeat give rows that repeat. Columns named like the two results are replaced; others stay.
    """
    return _scored(docs.drop("lang_pred", "score"), model, text_column, n, ["lang_pred", "score"])


def drop_unreadable(docs: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text", n: int = NGRAM) -> DataFrame:
    """The rows of ``docs`` in whose text the operator finds letters to tell a language by, with their columns as they are,
    whatever their names. NULL and empty texts and those without a letter go. No row goes by the name or cosine it gets,
    also where nothing was learned or a language is called ``und``."""
    names = fresh(docs, "lang_pred", "score", "letters")
    return _scored(docs, model, text_column, n, names).where(F.col(names[2])).select(*own_columns(docs))


def _scored(rows: DataFrame, model: tuple[list[str], np.ndarray], text_column: str, n: int, added: list[str]) -> DataFrame:
    """``rows`` with the columns ``added``: language, cosine and, where named, whether there is a letter."""
    langs, prototypes = model
    if not langs:
        prototypes = np.zeros((0, DIMENSIONS))
    place = rows.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, weights = Space(prototypes.shape[1], n), prototypes.astype(np.float32)
        for batch in batches:
            names, scores, letters = [], [], []
            for text in batch.column(place):
                vector = space.bundle(text.as_py()) if langs else None
                letters.append(vector is not None or (not langs and len(letters_of(text.as_py())) > 0))
                cosines = [0.0] if vector is None else (weights @ vector).tolist()
                scores.append(min(1.0, max(0.0, best := max(cosines))))
                names.append(UNKNOWN if vector is None else langs[cosines.index(best)])
            more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more[: len(added)]], names=[*batch.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, *(T.StructField(a, t) for a, t in zip(added, kinds, strict=False))]))


def held_out(id_column: Column | str = "doc_id", fold: int = 1, folds: int = 3) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``folds``, is ``fold``."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id_column, held_out, lang_pred, score`` per row, by the model of ``learned``. See ``with_language`` for nulls and
    empty texts; ids may repeat.
    """
    found = with_language(docs.select(id_column, text_column), learned(docs, id_column, text_column, lang_column, train_rows, dimensions), text_column)
    return found.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score")


def learned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """A model of a sample of the rows with a language that aren't held out."""
    labelled = docs.where(~held_out(docs[id_column]) & docs[lang_column].isNotNull() & docs[text_column].isNotNull())
    return learn(sampled(labelled, id_column, train_rows), text_column, lang_column, dimensions)
