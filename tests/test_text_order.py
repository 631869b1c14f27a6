"""Text sorts by letters, then accents and case; missing values last in both directions."""

from pyspark.sql import functions as F

from barloom.functions.scalars import humanize
from barloom.operators.downsample import sort_rows


def test_text_order(spark):
    df = spark.createDataFrame(list(enumerate(["b", "Á", "a", None, "A", "Z", "é", "e", "f"])), "i int, name string")
    names = lambda *a, **k: [r.name for r in sort_rows(df, "name", *a, row_id="i", **k).collect()]
    assert names() == ["a", "A", "Á", "b", "e", "é", "f", "Z", None]
    assert names(True) == ["Z", "f", "é", "e", "b", "Á", "A", "a", None]
    assert names(collation=None)[:3] == ["A", "Z", "a"]
    assert [r.i for r in sort_rows(df, "name", row_id="i", collation="UNICODE_CI_AI").collect()][:3] == [1, 2, 4]


def test_labels_are_worked_out_once(spark):
    """Each step of a label named the one before it several times, so that one label took dozens of patterns."""
    texts = ["2. open_PERatio", "10.5a: x  y", "1.2.3 z", "a1B", " _ ", "", None, "3.", "1a: HTMLPage_\tof\nx ", "plain", "1..b", "7:8:c"]
    labels = spark.createDataFrame([(t,) for t in texts], "t string").select(humanize(F.col("t")).alias("label"))
    plan = labels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3 and plan.count("split(") == 1
    assert [r.label for r in labels.collect()] == ["Open PE Ratio", "X y", "3 z", "A1 B", " _ ", "", None, "3.", "HTML Page of x", "Plain", ".b", "8:c"]
