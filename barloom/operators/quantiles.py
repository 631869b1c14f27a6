"""Exact linear-interpolation quantiles per key, whatever the size of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
SMALL = 1_000_000


def key_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], bounded: bool = True, small: int = SMALL
) -> DataFrame:
    """One row per key with a column per requested quantile of the present values.

    ``bounded`` says every key is known to be short (an uncut layout): Spark's exact ``percentile`` then
    holds one short group at a time. Otherwise ranks are located by repeated bucket counts, which only
    ever aggregate counts: each round splits the value range that holds the wanted rank into
    ``BUCKETS`` parts, and the last round sorts at most ``small`` values per rank.
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if bounded:
        return present.groupBy(*keys).agg(*(F.percentile("_v", F.lit(p)).alias(name) for name, p in probs.items()))
    return _by_narrowing(present, list(keys), dict(probs), small)


def _by_narrowing(present: DataFrame, keys: list[str], probs: dict[str, float], small: int) -> DataFrame:
    from barloom.session import cut_lineage

    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.lit(float(p)).alias("_p")) for n, p in probs.items())))
    totals = present.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = totals.select("*", wanted.alias("_w")).withColumn("_pos", F.col("_w._p") * (F.col("_n") - 1))
    ranks = place.select(
        *keys, "_lo", "_hi", F.col("_w._name").alias("_name"), (F.col("_pos") - F.floor("_pos")).alias("_part"),
        F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"), "_n",
    ).withColumn("_at", F.col("_rank"))
    ranks = cut_lineage(ranks)
    while True:
        open_ranks = ranks.filter((F.col("_lo") < F.col("_hi")) & (F.col("_n") > small))
        if open_ranks.limit(1).count() == 0:
            break
        spans = open_ranks.select(*keys, "_lo", "_hi").distinct()
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))
        counts = (
            present.join(spans, keys)
            .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*keys, "_lo", "_hi", part.alias("_part_no"))
            .agg(F.count("_v").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        )
        upto = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part_no").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_upto", F.sum("_c").over(upto))
        narrowed = (
            open_ranks.join(counts, [*keys, "_lo", "_hi"])
            .filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
            .select(
                *keys, F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_name", "_part", "_rank",
                F.col("_c").alias("_n"), (F.col("_at") - (F.col("_upto") - F.col("_c"))).alias("_at"),
            )
        )
        done = ranks.filter(~((F.col("_lo") < F.col("_hi")) & (F.col("_n") > small)))
        ranks = cut_lineage(done.unionByName(narrowed))
    # Few enough values are left in every range to sort them.
    flat = ranks.filter(F.col("_lo") == F.col("_hi")).withColumn("_value", F.col("_lo"))
    rest = ranks.filter(F.col("_lo") < F.col("_hi"))
    spans = rest.select(*keys, "_lo", "_hi").distinct()
    inside = (
        present.join(spans, keys)
        .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")) - 1)
    )
    found = rest.join(inside.withColumnRenamed("_v", "_value"), [*keys, "_lo", "_hi", "_at"])
    both = flat.select(*keys, "_name", "_part", "_rank", "_value").unionByName(found.select(*keys, "_name", "_part", "_rank", "_value"))
    value = F.min_by("_value", "_rank") + (F.max_by("_value", "_rank") - F.min_by("_value", "_rank")) * F.first("_part")
    long = both.groupBy(*keys, "_name").agg(value.alias("_q"))
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probs))
