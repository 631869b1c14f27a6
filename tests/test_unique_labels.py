"""Free labels: taken numbers in runs and gaps, and very many literals of one stem."""

import random

from pyspark.sql import functions as F

from barloom.operators.joins import unique_labels


def plain(rows):
    literals, seen, out = {label for label, _ in rows}, {}, []
    for label, at in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        seen.setdefault(label, []).append(at)
        if len(seen[label]) == 1:
            name, number = label, 1
        else:
            number = seen[label, "last"] + 1
            while f"{label}-{number}" in literals:
                number += 1
            name = f"{label}-{number}"
        seen[label, "last"] = number
        out.append((label, at, name))
    return sorted(out)


def test_runs_and_gaps_agree_with_a_plain_loop(spark):
    rng, rows = random.Random(2), []
    for k in range(700):
        stem = rng.choice(["x", "x", "x-2", "y z", "é-", "two\nlines"])
        number = rng.choice(["", "", "", f"-{rng.randint(0, 60)}", f"-0{rng.randint(2, 9)}", "-99999999999", "-999999999999999999999"])
        rows.append((stem + number, k))
    table = spark.createDataFrame(rows, "label string, at long")
    for parts in (1, 9):
        got = unique_labels(table.repartition(parts), "label", "at").select("label", "at", "unique_label")
        assert sorted(map(tuple, got.collect())) == plain(rows)


def test_a_million_literals_of_one_stem(spark):
    n = 1_000_000
    # Taken: 2 to n, without every 100,000th number; copies of x take these first and then those from n + 1 on.
    literals = spark.range(2, n + 1).where("id % 100000 <> 0").select(F.concat(F.lit("x-"), F.col("id").cast("string")).alias("label"), F.col("id").alias("at"))
    copies = spark.range(15).select(F.lit("x").alias("label"), F.col("id").alias("at"))
    got = unique_labels(literals.unionByName(copies), "label", "at")
    assert [r.unique_label for r in got.where("label = 'x'").orderBy("at").collect()] == ["x"] + [f"x-{k}00000" for k in range(1, 11)] + [f"x-{n + k}" for k in range(1, 5)]
    assert got.where("label <> 'x'").where("unique_label <> label").isEmpty() and got.count() == n - 11 + 15


def test_no_rows(spark):
    assert unique_labels(spark.createDataFrame([], "label string, at long"), "label", "at").collect() == []
