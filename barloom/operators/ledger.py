"""A hash-chained trial ledger as an append-only table of JSON lines.

Each line is an envelope (seq, type, at, dataset, prev, hash) and the fields of its type. The chain is
checked by joining each entry to the one before it; a line's own hash is a row expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ledger_udf import body_without_hash
from barloom.operators.ranking import global_rank
from barloom.session import cut_lineage
from barloom.sources.sinks import path_exists

GENESIS = "0" * 64
#: Folder of the marks; its name keeps it out of reads of the ledger.
MARKS = "_verified"
REQUIRED = {
    "seal": ("fraction", "holdout_start", "holdout_end", "holdout_bars", "research_bars", "research_fingerprint"),
    "run": ("run_id", "status", "settings", "trials"),
    "freeze": ("freeze_id", "run_id", "rules", "rules_hash", "frozen_at_bar"),
    "holdout_read": ("freeze_id", "result"),
}
ENVELOPE = ("seq", "type", "dataset", "hash", "prev", "at")
FIELDS = tuple(dict.fromkeys((*ENVELOPE, *(item for required in REQUIRED.values() for item in required))))
TIME_FORM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def entry_hash(prev: Column, line: Column) -> Column:
    """Digest of the previous hash and the entry without its own hash, in canonical form."""
    return F.sha2(F.concat(prev, body_without_hash(line)), 256)


def well_formed(field: Callable[[str], Column]) -> Column:
    """Envelope and per-type fields are present. ``field`` gives a top field of the line as text."""
    kind = field("type")
    ok = field("seq").rlike(r"^\d+$")
    for name in ENVELOPE[1:]:
        ok = ok & field(name).isNotNull()
    fields = F.lit(False)
    for name, required in REQUIRED.items():
        need = kind == name
        for item in required:
            need = need & field(item).isNotNull()
        fields = fields | need
    runs = (kind != "run") | (F.get_json_object(field("settings"), "$.costs").startswith("{") & field("trials").startswith("["))
    return F.coalesce(ok & fields & runs & field("at").rlike(TIME_FORM), F.lit(False))


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns, each worked out once a row: a projection would be merged into every later use of them."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbered lines of a ledger (single writer: one file part per append, in name order)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_n"))
    return global_rank(raw, [F.col("_f"), F.col("_s"), F.col("_n")], "line_no").select("line_no", "value")


def read_ledger(lines: DataFrame, keys: Sequence[str] = (), after: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """Well-formed entries and, per line, what is wrong with it (NULL when nothing is).

    With ``keys`` each key is a ledger of its own, numbered by ``line_no``. ``after`` is the sequence and hash of the entry
    that the lines follow, for the tail of a ledger whose beginning is verified.
    """
    keys, (start, start_hash) = list(keys), after
    # Lines are spread out and read in one go each; few long ones may lie in one split of a file.
    spread = lines.select(*keys, "line_no", "value").repartition(*keys, "line_no", "value")
    read = spread.select("*", F.json_tuple("value", *FIELDS).alias(*(f"_{name}" for name in FIELDS)))
    read = _once(read, F.try_parse_json("value").isNotNull().alias("_json"))
    read = _once(read, (F.col("_json") & well_formed(lambda name: F.col(f"_{name}"))).alias("ok"))
    field = lambda name: F.when(F.col("ok"), F.col(f"_{name}"))
    # Written once: numbering, its sample of the rows and the join below would each read every line again.
    entries = cut_lineage(read.select(
        *keys, "line_no", "value", "ok", field("seq").try_cast("long").alias("seq"), field("type").alias("type"), field("at").alias("at"),
        field("dataset").alias("dataset"), field("prev").alias("prev"), field("hash").alias("hash"),
        F.when(~F.col("_json"), "is not valid JSON").when(~F.col("ok"), "is not a valid ledger entry").alias("shape"),
    ))
    # Good entries are numbered by a distributed sort; each then meets the one before it by its number.
    numbered = global_rank(entries.where("ok").select(*keys, "line_no", "hash"), [F.col(c) for c in (*keys, "line_no")], "_place")
    earlier = numbered.select(*keys, (F.col("_place") + 1).alias("_place"), F.col("hash").alias("_previous"))
    chain = numbered.drop("hash").join(earlier.hint("merge"), [*keys, "_place"], "left")
    if keys:
        first = numbered.groupBy(*keys).agg((F.min("_place") - 1).alias("_before"))
        chain = chain.join(first, keys).withColumn("_place", F.col("_place") - F.col("_before")).drop("_before")
    chain = chain.withColumn("_place", F.col("_place") + start)
    checked = entries.join(chain, [*keys, "line_no"], "left").withColumn("_previous", F.coalesce("_previous", F.lit(start_hash)))
    problem = (
        F.when(F.col("shape").isNotNull(), F.col("shape"))
        .when(F.col("seq") != F.col("_place"), F.concat(F.lit("has sequence "), F.col("seq").cast("string"), F.lit(", expected "), F.col("_place").cast("string")))
        .when(F.col("prev") != F.col("_previous"), "does not follow the previous entry")
        .when(F.col("hash") != entry_hash(F.col("_previous"), F.col("value")), "does not match its hash")
    )
    return checked.withColumn("problem", problem).drop("_place", "_previous", "shape")


def verify_ledger(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether the chain (of each key) is intact, and the first problem."""
    text = F.concat_ws(" ", F.lit("line"), F.col("line_no").cast("string"), F.col("problem"))
    return entries.groupBy(*keys).agg(F.count_if(F.col("problem").isNotNull()).alias("_bad"), F.min_by(F.when(F.col("problem").isNotNull(), text), F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("problem")).select(
        *keys, (F.col("_bad") == 0).alias("intact"), "problem"
    )


def trials(entries: DataFrame) -> DataFrame:
    """Distinct (dataset, rule) pairs ever evaluated: first seen and number of runs."""
    runs = entries.filter(F.col("ok") & (F.col("type") == "run"))
    each = runs.select("dataset", "at", F.explode(F.from_json(F.get_json_object("value", "$.trials"), "ARRAY<STRUCT<key: STRING, rule_id: STRING>>")).alias("t"))
    return each.groupBy("dataset", F.col("t.key").alias("key"), F.col("t.rule_id").alias("rule_id")).agg(F.min("at").alias("first_seen"), F.count(F.lit(1)).alias("runs"))


def ledger_state(entries: DataFrame) -> DataFrame:
    """First seal, freeze and holdout read, runs and trials of each dataset."""
    good = entries.filter("ok")
    first = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("value")), F.when(F.col("type") == kind, F.col("seq"))).alias(kind)
    status = F.get_json_object("value", "$.status")
    state = good.groupBy("dataset").agg(
        first("seal"), first("freeze"), first("holdout_read"), F.count_if(F.col("type") == "run").alias("runs"),
        F.count_if((F.col("type") == "run") & (status == "completed")).alias("completed_runs"),
        F.max_by(F.when(F.col("type") == "run", F.col("value")), F.when(F.col("type") == "run", F.col("seq"))).alias("latest_run"),
    )
    counted = trials(entries).groupBy("dataset").agg(F.count(F.lit(1)).alias("trials"))
    return state.join(counted, "dataset", "left").fillna(0, ["trials"])


def ledger_view(entries: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries with a one-line summary."""
    kind = F.col("type")
    item = lambda name: F.get_json_object("value", f"$.{name}")
    text = (
        F.when(kind == "seal", F.concat(F.lit("Sealed "), item("holdout_bars"), F.lit(" bars")))
        .when(kind == "run", F.concat(F.lit("Run "), item("run_id"), F.lit(" "), item("status")))
        .when(kind == "freeze", F.concat(F.lit("Froze rules of run "), item("run_id")))
        .otherwise(F.concat(F.lit("Read the holdout for "), item("freeze_id")))
    )
    return entries.filter("ok").select("seq", "type", "at", "dataset", text.alias("summary")).orderBy(F.col("seq").desc()).limit(limit)


def allowed(state: DataFrame) -> DataFrame:
    """What each dataset may do next: one seal, a freeze of the latest candidate run, one holdout read."""
    label = F.get_json_object("latest_run", "$.verdict")
    return state.select(
        "dataset", F.col("seal").isNull().alias("can_seal"),
        (F.col("seal").isNotNull() & F.col("freeze").isNull() & F.coalesce(label == "CANDIDATE", F.lit(False))).alias("can_freeze"),
        (F.col("freeze").isNotNull() & F.col("holdout_read").isNull()).alias("can_read_holdout"),
    )


def _files(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _part(path: str, seq: int) -> str:
    return f"{path}/seq={seq:012d}"


def read_mark(spark: SparkSession, path: str) -> dict | None:
    """The newest mark of a verified beginning: sequence and hash of its last entry, and the running digest of its parts."""
    if not path_exists(spark, f"{path}/{MARKS}"):
        return None
    return max((json.loads(r.value) for r in spark.read.text(f"{path}/{MARKS}").collect()), key=lambda m: m["seq"], default=None)


def _write_mark(spark: SparkSession, path: str, mark: dict) -> None:
    """A new file first, then the older ones go; a writer that stops in between leaves two, of which the newer counts."""
    fs, folder = _files(spark, f"{path}/{MARKS}")
    old = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"mark-{mark['seq']:012d}.json"), True)
    try:
        out.write(bytearray(json.dumps(mark, sort_keys=True).encode()))
    finally:
        out.close()
    for file in old:
        if file.getName() != f"mark-{mark['seq']:012d}.json":
            fs.delete(file, False)


def _part_bytes(spark: SparkSession, path: str, seq: int) -> int:
    fs, folder = _files(spark, _part(path, seq))
    return fs.getContentSummary(folder).getLength() if fs.exists(folder) else -1


def _grown(digest: str, seq: int, size: int) -> str:
    return hashlib.sha256(f"{digest}:{seq}:{size}".encode()).hexdigest()


def parts_match(spark: SparkSession, path: str) -> bool:
    """Whether the parts before the mark still are as many and as long as when they were verified; reads no text. A changed
    text of the same length is found by ``verify_ledger`` over the whole ledger."""
    mark = read_mark(spark, path)
    digest = ""
    for seq in range(1, (mark["seq"] if mark else 0) + 1):
        digest = _grown(digest, seq, _part_bytes(spark, path, seq))
    return mark is None or digest == mark["parts"]


def verified_mark(spark: SparkSession, path: str) -> dict:
    """The mark moved to the last entry. Only what follows the old mark, and the entry it names, is read; without a mark
    the whole ledger is. A broken chain is refused."""
    mark = read_mark(spark, path)
    fresh = {"seq": 0, "hash": GENESIS, "parts": ""}
    if not path_exists(spark, path):
        return fresh
    if mark:
        held = [r.value for r in spark.read.text(_part(path, mark["seq"])).collect()] if path_exists(spark, _part(path, mark["seq"])) else []
        if len(held) != 1 or not _seals(held[0], mark):
            raise RuntimeError("ledger integrity check failed: the last verified entry has changed")
    at = mark or fresh
    if mark:
        tail = []
        while path_exists(spark, _part(path, at["seq"] + len(tail) + 1)):
            tail.append(_part(path, at["seq"] + len(tail) + 1))
        lines = read_lines(spark, tail) if tail else None
    else:
        lines = read_lines(spark, path)
    if lines is None:
        return at
    entries = cut_lineage(read_ledger(lines, after=(at["seq"], at["hash"])))
    if not verify_ledger(entries).first().intact:
        raise RuntimeError("ledger integrity check failed")
    last = entries.agg(F.max("seq").alias("s"), F.max_by("hash", "seq").alias("h")).first()
    if last.s is None:
        return at
    digest = at["parts"]
    for seq in range(at["seq"] + 1, last.s + 1):
        digest = _grown(digest, seq, _part_bytes(spark, path, seq))
    return {"seq": last.s, "hash": last.h, "parts": digest}


def _seals(line: str, mark: dict) -> bool:
    """Whether a line is the entry a mark names, unchanged."""
    try:
        entry = json.loads(line)
        given = entry.pop("hash")
        return entry["seq"] == mark["seq"] and given == mark["hash"] == _digest(entry)
    except (AttributeError, KeyError, TypeError, ValueError):
        return False


def _canonical(entry: dict) -> str:
    return json.dumps(entry, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _digest(entry: dict) -> str:
    return hashlib.sha256((entry["prev"] + _canonical(entry)).encode()).hexdigest()


def append_entry(spark: SparkSession, path: str, kind: str, dataset: str, body: dict, at: str) -> dict:
    """Append one entry after the chain check; refused while the chain is broken. Single writer.

    What was verified before isn't read again (see ``verified_mark``), so an append costs the same at any age. A writer
    that stops before the mark moves leaves an entry that the next append verifies.
    """
    if kind not in REQUIRED:
        raise ValueError(f"unknown entry type {kind!r}")
    mark = verified_mark(spark, path)
    entry = {**body, "seq": mark["seq"] + 1, "type": kind, "at": at, "dataset": dataset, "prev": mark["hash"]}
    entry["hash"] = _digest(entry)
    spark.createDataFrame([(_canonical(entry),)], "value string").coalesce(1).write.mode("append").text(_part(path, entry["seq"]))
    _write_mark(spark, path, {"seq": entry["seq"], "hash": entry["hash"], "parts": _grown(mark["parts"], entry["seq"], _part_bytes(spark, path, entry["seq"]))})
    return entry
