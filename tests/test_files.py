"""Catalogue, sidecars, summaries and file sinks."""

from barloom.operators.aggregates import quality_report
from barloom.sources.ohlcv import dataset_catalog, dataset_identity, dataset_summary, read_ohlcv, read_ohlcv_loose, read_sidecars
from barloom.sources.sinks import write_enriched, write_report
from tests.fixtures import bars_frame, seeded_bars


def test_catalogue_and_summary(spark, tmp_path):
    folder = tmp_path / "AAA"
    folder.mkdir()
    head = "index,time,open,high,low,close,volume\n"
    (folder / "5.csv").write_text(head + "[1],2024-01-01 10:00:00,1,2,0.5,1,3\n")
    (folder / "bad.csv").write_text(head + "[1],never,1,2,0.5,1,3\n")
    (folder / "5.csv.meta.json").write_text('{"schema_version": 1, "symbol": "NSE:AAA", "timeframe": "5"}')
    catalog = dataset_catalog(spark, str(tmp_path))
    assert {(r.symbol, r.timeframe) for r in catalog.collect()} == {("AAA", "5"), ("AAA", "bad")}
    named = dataset_identity(catalog, read_sidecars(spark, str(tmp_path)))
    assert {(r.symbol, r.timeframe) for r in named.collect()} == {("NSE:AAA", "5"), ("AAA", "bad")}
    bars, _ = read_ohlcv(spark, str(tmp_path))
    summary = {r.timeframe: r for r in dataset_summary(catalog, bars).collect()}
    assert summary["5"].valid and summary["5"].rows == 1 and summary["5"].error is None
    assert not summary["bad"].valid and summary["bad"].rows == 0


def test_file_sinks(spark, tmp_path):
    bars = bars_frame(spark, seeded_bars(60))
    write_enriched(bars, str(tmp_path / "enriched"))
    assert spark.read.parquet(str(tmp_path / "enriched")).filter("ema_20 is not null").count() == 41
    write_report(quality_report(bars), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().valid_rows == 60


HEAD = "time,open,high,low,close,volume"


def test_each_file_has_its_own_header_and_separator(spark, tmp_path):
    for name, text in {
        "a/1.csv": f"{HEAD}\n2024-01-02,1,4,0.5,2,10\n",
        "b/1.csv": "time,close,high,low,open,volume\n2024-01-02,2,4,0.5,1,10\n",
        "flat.csv": f"{HEAD}\n2024-01-02,1,4,0.5,2,10\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    bars, counts = read_ohlcv(spark, str(tmp_path))
    assert {(r.symbol, r.timeframe, r.open, r.close) for r in bars.collect()} == {("a", "1", 1, 2), ("b", "1", 1, 2), ("flat", "", 1, 2)}
    assert {(r.symbol, r.valid_rows, r.dropped_rows) for r in counts.collect()} == {("a", 1, 0), ("b", 1, 0), ("flat", 1, 0)}
    (tmp_path / "b/2.csv").write_text('Close;"Date";HIGH;Low;Open;Volume\r\n2;"2024-01-02";4;0.5;1;10\r\n')
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.csv").write_text("time,open\n2024-01-02,1\n")
    bars, counts = read_ohlcv_loose(spark, str(tmp_path))
    assert {(r.symbol, r.timeframe, r.open, r.close) for r in bars.collect()} == {("a", "1", 1, 2), ("b", "1", 1, 2), ("b", "2", 1, 2), ("flat", "", 1, 2)}
    assert {(r.symbol, r.dropped_rows) for r in counts.where("dropped_rows > 0").collect()} == {("c", 1)}
