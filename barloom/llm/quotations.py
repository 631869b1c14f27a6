"""Chat formatting by quotation linking, with DataFrame functions only.

A message is cut into lines; the quote level of a line is the number of ``>`` it begins with. Neighbouring lines of
one level form a passage, which a blank line ends. Quoted passages, and each of their lines, are normalised (lower
case, single spaces) and hashed; so are the paragraphs, lines and the whole of what each message says itself. Within
a conversation a quoted hash is linked to the last earlier message that says it: both sides are put in one column
ordered by turn and the last original is carried forward, so a passage that a long conversation repeats costs its
rows, not their pairs.

A message replies to what its outermost linked quote comes from, else to the message before it. A reply always follows
the message it replies to, so turns in their order are a reply order. The text is returned without quotes and without
the line that introduces one ("On ... wrote:").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTE, INTRODUCTION = r"^((?:[ \t]*>)*)", r"(?i)^on .+ wrote:$"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")))


def _joined(between: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("at", "content")))
    return F.array_join(F.transform(rows, lambda r: r["content"]), between)


def message_lines(messages: DataFrame) -> DataFrame:
    """Lines of ``conv_id, turn, key, text`` with level, content, passage number and whether it introduces a quote."""
    prefix = F.regexp_extract("line", QUOTE, 1)
    lines = messages.select("conv_id", "turn", "key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "key", "at", F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.when(F.length(prefix) > 0, F.trim(F.substr("line", F.length(prefix) + 1))).otherwise(F.col("line")).alias("content"))
    order = Window.partitionBy("conv_id", "turn", "key").orderBy("at")
    blank = F.trim("content") == ""
    fresh = (F.lag("level").over(order) != F.col("level")) | blank | F.lag(blank).over(order)
    introduces = (F.col("level") == 0) & (F.lead("level").over(order) > 0) & F.trim("content").rlike(INTRODUCTION)
    return lines.withColumns({"fresh": F.coalesce(fresh, F.lit(True)).cast("int"), "introduces": F.coalesce(introduces, F.lit(False))}).withColumn("passage", F.sum("fresh").over(order))


def link_quotes(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``conv_id, seq, turn, role, reply_to, n_quotes, n_linked, text`` per message: its place in the reply order (from
    0), the turn it replies to (NULL for the first), its quoted passages, how many of them were found in an earlier
    turn, and its own words.

    Rows that repeat count once. Messages without conversation or turn are left out; a NULL text counts as empty.
    Several messages of one turn keep a fixed order, and none replies to another of its own turn by a quote. Other
    columns aren't read. An empty table gives none.
    """
    named = conversations.select(conversations[conv_column].alias("conv_id"), conversations[turn_column].alias("turn"), conversations[role_column].cast("string").alias("role"), F.coalesce(conversations[text_column].cast("string"), F.lit("")).alias("text"))
    messages = named.where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct().withColumn("key", F.sha2(F.concat_ws("\n", F.coalesce("role", F.lit("")), "text"), 256))
    lines = message_lines(messages)
    own = lines.where((F.col("level") == 0) & ~F.col("introduces"))
    said = own.groupBy("conv_id", "turn", "key").agg(_joined("\n").alias("raw")).withColumn("text", F.regexp_replace("raw", r"^\s+|\s+$", ""))

    keys = ["conv_id", "turn"]
    worded = F.trim("content") != ""
    paragraphs = own.where(worded).groupBy(*keys, "key", "passage").agg(_joined(" ").alias("unit"))
    originals = (
        paragraphs.select(*keys, "unit")
        .unionByName(own.where(worded).select(*keys, F.col("content").alias("unit")))
        .unionByName(said.select(*keys, F.regexp_replace("text", r"\s+", " ").alias("unit")))
        .select(*keys, F.xxhash64(_normal(F.col("unit"))).alias("hash"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("passage"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("whole"))
        .distinct()
    )
    quoted = lines.where((F.col("level") > 0) & worded)
    passages = quoted.groupBy(*keys, "key", "passage", "level").agg(_joined(" ").alias("unit"))
    asked = passages.withColumn("whole", F.lit(True)).unionByName(quoted.select(*keys, "key", "passage", "level", F.col("content").alias("unit"), F.lit(False).alias("whole")))
    asked = asked.select(*keys, F.xxhash64(_normal(F.col("unit"))).alias("hash"), "key", "passage", "level", "whole")
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = originals.unionByName(asked).withColumn("source", F.max(F.when(F.col("key").isNull(), F.col("turn"))).over(before)).where("key IS NOT NULL")
    # A passage found whole counts before its single lines, the later source before the earlier.
    links = met.groupBy(*keys, "key", "passage", "level").agg(F.max(F.when(F.col("source").isNotNull(), F.struct("whole", "source"))).alias("found"))
    replies = links.groupBy(*keys, "key").agg(F.count("*").alias("n_quotes"), F.count("found").alias("n_linked"), F.min(F.when(F.col("found").isNotNull(), F.struct("level", "passage", "found.source"))).alias("outermost"))

    order = Window.partitionBy("conv_id").orderBy("turn", "key")
    rows = messages.drop("text").join(said.drop("raw"), [*keys, "key"], "left").join(replies, [*keys, "key"], "left")
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "turn",
        "role",
        F.coalesce(F.col("outermost.source"), F.lag("turn").over(order)).alias("reply_to"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def chats(linked: DataFrame, page: int = 256) -> DataFrame:
    """``conv_id, page, messages array<struct<role, content>>``: conversations in reply order, in pages of a bounded
    number of messages."""
    rows = linked.withColumn("page", F.floor(F.col("seq") / page))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    return rows.groupBy("conv_id", "page").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


SQL = r"""
WITH messages AS (
    SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text, sha256(concat(coalesce(role, ''), chr(10), coalesce(text, ''))) AS key
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), cut AS (
    SELECT conv_id, turn, key, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM messages
), levelled AS (
    SELECT conv_id, turn, key, pos, len(regexp_replace(p, '[^>]', '', 'g')) AS level, CASE WHEN p <> '' THEN trim(substr(line, len(p) + 1), ' ') ELSE line END AS content
    FROM (SELECT *, regexp_extract(line, '^((?:[ \t]*>)*)', 1) AS p FROM cut)
), placed AS (
    SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn, key ORDER BY pos) AS passage FROM (
        SELECT *, CASE WHEN lag(level) OVER o IS NULL OR lag(level) OVER o <> level OR trim(content, ' ') = '' OR trim(lag(content) OVER o, ' ') = '' THEN 1 ELSE 0 END AS fresh,
               coalesce(level = 0 AND lead(level) OVER o > 0 AND regexp_matches(trim(content, ' '), '(?i)^on .+ wrote:$'), FALSE) AS introduces
        FROM levelled WINDOW o AS (PARTITION BY conv_id, turn, key ORDER BY pos))
), own AS (SELECT * FROM placed WHERE level = 0 AND NOT introduces),
said AS (
    SELECT conv_id, turn, key, regexp_replace(string_agg(content, chr(10) ORDER BY pos), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS text FROM own GROUP BY ALL
), units AS (
    SELECT conv_id, turn, string_agg(content, ' ' ORDER BY pos) AS unit FROM own WHERE trim(content, ' ') <> '' GROUP BY conv_id, turn, key, passage
    UNION SELECT conv_id, turn, content FROM own WHERE trim(content, ' ') <> ''
    UNION SELECT conv_id, turn, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') FROM said
), originals AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(unit, '[ \t\r\f\x0B]+', ' ', 'g'), ' ')) AS unit FROM units),
quoted AS (SELECT * FROM placed WHERE level > 0 AND trim(content, ' ') <> ''),
asked AS (
    SELECT conv_id, turn, key, passage, level, string_agg(content, ' ' ORDER BY pos) AS unit, TRUE AS whole FROM quoted GROUP BY conv_id, turn, key, passage, level
    UNION ALL SELECT conv_id, turn, key, passage, level, content, FALSE FROM quoted
), met AS (
    SELECT a.conv_id, a.turn, a.key, a.passage, a.level, a.whole, max(o.turn) AS source
    FROM asked a LEFT JOIN originals o ON o.conv_id = a.conv_id AND o.turn < a.turn AND o.unit = lower(trim(regexp_replace(a.unit, '[ \t\r\f\x0B]+', ' ', 'g'), ' '))
    GROUP BY a.conv_id, a.turn, a.key, a.passage, a.level, a.whole
), links AS (
    SELECT conv_id, turn, key, passage, level, coalesce(max(source) FILTER (WHERE whole), max(source)) AS source FROM met GROUP BY ALL
), replies AS (
    SELECT conv_id, turn, key, count(*) AS n_quotes, count(source) AS n_linked, arg_min(source, level * 1000000 + passage) FILTER (WHERE source IS NOT NULL) AS source FROM links GROUP BY ALL
)
SELECT m.conv_id, row_number() OVER o - 1 AS seq, m.turn, m.role, coalesce(r.source, lag(m.turn) OVER o) AS reply_to,
       coalesce(r.n_quotes, 0)::BIGINT AS n_quotes, coalesce(r.n_linked, 0)::BIGINT AS n_linked, coalesce(s.text, '') AS text
FROM messages m LEFT JOIN said s USING (conv_id, turn, key) LEFT JOIN replies r USING (conv_id, turn, key)
WINDOW o AS (PARTITION BY m.conv_id ORDER BY m.turn, m.key)
"""
