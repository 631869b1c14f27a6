"""Line dedup by distinct-site spread, with DataFrame functions only.

Every line of ``min_words`` words or more (by default all but those of white space) is hashed. Per hash a HyperLogLog sketch of the sites it stands on is built
by partial aggregation and merged, so one line on every page of the web is one small row per task. Lines whose
estimate is within ``band`` standard errors of the threshold are counted exactly. A line on ``min_sites`` sites or more
is boilerplate: its first occurrence (least document id, then line number) stays, so that nothing is lost from the
corpus, and all others go.

Decisions meet the documents again by their id; line numbers to drop are gathered per document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.storage import fresh, stored

MIN_SITES, MIN_WORDS, LOG_REGISTERS, BAND = 10, 1, 10, 4.0


def lines_of(docs: DataFrame, id_column: str, text_column: str, site_column: str, min_words: int) -> DataFrame:
    """``id, site, at`` (from 0) and the two hashes ``a, b`` of each trimmed line with enough words. With ``min_words=1``
    these are all lines but those of white space."""
    rows = docs.select(docs[id_column].alias("id"), docs[site_column].cast("string").alias("site"), F.posexplode(F.split(docs[text_column].cast("string"), "\n")).alias("at", "raw"))
    line = F.trim("raw")
    rows = rows.select("id", "site", "at", line.alias("line")).where(F.col("line").rlike(r"\S") & (F.size(F.split("line", r"\s+")) >= min_words))
    return rows.select("id", "site", "at", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS, band: float = BAND) -> DataFrame:
    """``a, b, first_id, first_at``: the lines on ``min_sites`` sites or more, with their first occurrence. Lines
    without site count for none."""
    place = F.when(F.col("id").isNotNull(), F.struct("id", "at"))
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(log_registers)).alias("sketch"), F.min(place).alias("first"))
    margin = 1 + band * 1.04 / 2 ** (log_registers / 2) * min_sites
    estimate = F.hll_sketch_estimate("sketch")
    spread = spread.select("a", "b", estimate.alias("sites"), F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at")).where(F.col("sites") >= min_sites - margin)
    # Few lines are left: they are written once, so that the documents aren't read again for each use.
    spread = stored(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where(F.col("sites") <= min_sites + margin)
    exact = lines.where("site IS NOT NULL").join(near.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("exact"))
    near = near.join(exact.where(F.col("exact") >= min_sites), ["a", "b"], "left_semi")
    return sure.unionByName(near).drop("sites")


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    min_sites: int = MIN_SITES,
    min_words: int = MIN_WORDS,
    log_registers: int = LOG_REGISTERS,
    n_lines: str = "n_lines",
    n_removed: str = "n_removed",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the columns ``n_lines, n_removed`` (long).

    Lines are separated by a newline and compared trimmed of spaces; the kept ones are joined as they were. A NULL text
    stays NULL with no lines; an empty one has one line. Rows without id keep all their lines (they are counted all
    the same), as do lines with too few words. Rows that repeat an id and text are treated alike: a first occurrence
    stays in each of them. A column named like one of the two
    added here is replaced. An empty table gives an
    empty one.
    """
    own_lines, own_id, own_drop = fresh(docs, "__lines", "__id", "__drop")
    lines = lines_of(docs, id_column, text_column, site_column, min_words)
    found = boilerplate(lines, min_sites, log_registers)
    marked = lines.where("id IS NOT NULL").join(found, ["a", "b"]).where(~(F.col("first_id").eqNullSafe(F.col("id")) & F.col("first_at").eqNullSafe(F.col("at"))))
    drops = marked.groupBy("id").agg(F.collect_set("at").alias("drop")).select(F.col("id").alias(own_id), F.col("drop").alias(own_drop))
    # The lines are a column of the join's input: what is picked from them below isn't split again.
    cut = docs.withColumn(own_lines, F.split(docs[text_column].cast("string"), "\n")).drop(text_column)
    joined = cut.join(drops, cut[id_column] == drops[own_id], "left")
    return joined.select(*[_column(name, text_column, own_lines, own_drop) for name in docs.columns if name not in (n_lines, n_removed)], F.coalesce(F.size(own_lines), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(own_drop), F.lit(0)).cast("long").alias(n_removed)).withColumns({n_lines: F.greatest(F.col(n_lines), F.lit(0)), n_removed: F.greatest(F.col(n_removed), F.lit(0))})


def _column(name: str, text_column: str, lines: str, drop: str) -> Column:
    if name != text_column:
        return F.col(f"`{name}`")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.transform(numbers, lambda at: F.get(F.col(lines), at))
    return F.when(F.col(drop).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n")).alias(name)


SQL = r"""
WITH cut AS (
    SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), keyed AS (
    SELECT *, trim(line, ' ') AS k, regexp_matches(line, '[^ \t\n\x0B\f\r]') AS counts FROM cut
), spread AS (
    SELECT k FROM keyed WHERE counts GROUP BY k HAVING count(DISTINCT source) >= 10
), placed AS (
    SELECT *, counts AND k IN (SELECT k FROM spread) AS common, row_number() OVER (PARTITION BY k, counts ORDER BY doc_id, pos) AS n FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE common AND n > 1)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (common AND n > 1)), '')) AS kept_sha256
FROM placed GROUP BY doc_id
"""
