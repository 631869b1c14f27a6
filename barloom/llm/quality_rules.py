"""Quality rules, and the cross-document frequency of lines.

One Arrow pass takes the figures of each text and the hashes of its distinct normalised lines (words joined by one
space, A-Z lower-cased, digits as 0). Lines are then counted by host: a document has a line once, so the count of rows
is the count of documents, and Spark adds it up before the shuffle. A line in more than ``most_docs`` documents of its
host, and in more than one of ``one_in`` of them, is above the limits. Such lines are taken out, and a document that
less than half of its words are left of is depleted.

Lines above the limits meet the documents again by host, hash and a salt, so that a line of a third of all documents is
dealt out; each document then gets one small row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from barloom.llm.storage import stored

MOST_DOCS, ONE_IN, SALTS = 10, 1000, 16
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NORMAL = bytes(b | 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that stands in the text twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    often = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(often)] |= often
    return int(inside.sum())


def figures(text: str | None) -> tuple[tuple[int, ...], list[list[bytes]]]:
    """The five figures, and the words of each line that has some."""
    text = text or ""
    raw = text.encode().split(b"\n")
    lines = [words for line in raw if (words := line.split())]
    own = [w for words in lines for w in words]
    distinct = len({line for line in raw if line.split()})
    return (len(own), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - distinct, repeated_words(own)), lines


def line_key(words: list[bytes]) -> bytes:
    return xxh3_128_digest(b" ".join(words).translate(NORMAL))


def _facts(rows: DataFrame) -> DataFrame:
    """``row, id, host``, the figures, and ``lines``: the key of each distinct line with its words in all places."""
    pair = pa.struct([("line", pa.binary()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lines = [], []
            for text in batch.column(3):
                found, own = figures(text.as_py())
                words: dict[bytes, int] = {}
                for line in own:
                    words[key] = words.get(key := line_key(line), 0) + len(line)
                numbers.append(found)
                lines.append([{"line": k, "words": n} for k, n in words.items()])
            columns = [pa.array([n[k] for n in numbers], pa.int64()) for k in range(len(FIGURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array(lines, pa.list_(pair))], names=["row", "id", "host", *FIGURES, "lines"])

    kind = rows.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{name} long" for name in FIGURES)
    return rows.select("row", "id", "host", "text").mapInArrow(run, f"row long, id {kind}, host string, {numbers}, lines array<struct<line: binary, words: bigint>>")


def _common(facts: DataFrame, most_docs: int, one_in: int) -> DataFrame:
    """``row, line, words``: the lines above the limits of each document."""
    lines = facts.where("host IS NOT NULL").select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_docs)
    hosts = facts.groupBy("host").agg(F.count("*").alias("docs"))
    above = stored(counts.join(hosts, "host").where(F.col("n") * one_in > F.col("docs")).select("host", "line"), "common_lines")
    salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"]).select("row", "line", "words")


def _rows(docs: DataFrame, id_column: str, text_column: str, host_column: str, *more) -> DataFrame:
    names = (docs[id_column].alias("id"), docs[host_column].cast("string").alias("host"), docs[text_column].cast("string").alias("text"))
    return docs.select(F.monotonically_increasing_id().alias("row"), *names, *more)


def _judged(facts: DataFrame, common: DataFrame) -> DataFrame:
    lost = common.groupBy("row").agg(F.sum("words").alias("lost"))
    judged = facts.drop("lines").join(lost, "row", "left").withColumn("n_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("n_left") >= F.col("n_words")))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", most_docs: int = MOST_DOCS, one_in: int = ONE_IN) -> DataFrame:
    """``id_column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left`` per row.

    ``n_left`` counts the words outside lines above the limits. A NULL or empty text has no words and fails. Every row
    is a document of its own, also where ids repeat or are NULL. Rows without host have no common lines. Other columns
    aren't read. A count at a limit isn't above it. An empty table gives none.
    """
    facts = stored(_facts(_rows(docs, id_column, text_column, host_column)), "quality")
    judged = _judged(facts, _common(facts, most_docs, one_in))
    return judged.select(F.col("id").alias(id_column), *FIGURES, "base_failed", "kept", "n_left")


def without_common_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", most_docs: int = MOST_DOCS, one_in: int = ONE_IN) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their columns, whatever their names; the text (a string) is
    without its lines above the limits. Other lines, those of white space too, stay as they are."""
    rows = stored(_rows(docs, id_column, text_column, host_column, F.struct("*").alias("doc")), "quality_rows")
    facts = stored(_facts(rows), "quality")
    common = stored(_common(facts, most_docs, one_in), "common_places")
    kept = _judged(facts, common).where("kept").select("row")
    drops = common.groupBy("row").agg(F.collect_set("line").alias("drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = set(drop or ())
                lines = text.split("\n")
                texts.append("\n".join(line for line in lines if not ((words := line.encode().split()) and line_key(words) in gone)) if gone else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    joined = rows.join(kept, "row", "left_semi").join(drops, "row", "left").select("doc", "text", "drop")
    cleaned = joined.mapInArrow(run, rows.select("doc", "text").schema)
    return cleaned.select(*(F.col("text").alias(name) if name == text_column else F.col("doc").getField(name).alias(name) for name in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), cut AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
    SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
           translate(regexp_replace(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), '[0-9]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM cut WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), above AS (
    SELECT source, k FROM (SELECT source, k, count(DISTINCT r) AS n FROM lines GROUP BY 1, 2) JOIN (SELECT source, count(*) AS docs FROM d GROUP BY 1) USING (source)
    WHERE n > 10 AND n * 1000 > docs
), lost AS (SELECT r, sum(words) AS lost FROM lines SEMI JOIN above USING (source, k) GROUP BY 1
), dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1
), w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), often AS (SELECT r, i, w, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1)::INT AS x FROM g
), inside AS (SELECT r, length(w) AS n, greatest(x, lag(x, 1, 0) OVER o, lag(x, 2, 0) OVER o) AS x FROM often WINDOW o AS (PARTITION BY r ORDER BY i)
), sums AS (SELECT r, count(*) AS n_words, sum(n) AS word_chars, sum(x) AS n_repeat_words FROM inside GROUP BY 1
), figures AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (coalesce(n_words, 0) - coalesce(lost, 0))::BIGINT AS n_left
    FROM d LEFT JOIN sums USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost USING (r)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND 2 * n_left >= n_words AS kept FROM judged
"""
