"""Chat formatting by quotation linking. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, met_by, saved

#: Turns, or threads, that are ranked together.
BLOCK = 4096
QUOTE = r"^[ \t]*((?:>[ \t]*)+)(.*)$"
KEYS = ["conv", "turn"]
#: Words of a run by which quoted passages are found.
SHINGLE = 5


def normal(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the attribution ("On ... wrote:") right above them."""
    text = F.regexp_replace(text, r"(?im)^on [^\n]*wrote:[ \t]*\n(?=[ \t]*>)", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]*>[^\n]*(?:\n|$)", ""), r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))


def _passages(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, hash) of what each quote level of each message says (level 0: what isn't quoted): its runs of `SHINGLE` words over all its lines, and its lines of fewer words."""

    def parsed(line: Column) -> Column:
        mark = F.regexp_extract(line, QUOTE, 1)
        body = normal(F.when(mark == "", line).otherwise(F.regexp_extract(line, QUOTE, 2)))
        return F.struct(F.length(F.regexp_replace(mark, r"[^>]", "")).alias("level"), body.alias("body"))

    x = rows.select(*KEYS, F.filter(F.transform(F.split("text", "\n"), parsed), lambda p: p["body"] != "").alias("lines"))
    x = x.select(*KEYS, "lines", F.explode(F.array_distinct(F.transform("lines", lambda p: p["level"]))).alias("level"))
    x = x.select(*KEYS, "level", F.transform(F.filter("lines", lambda p: p["level"] == F.col("level")), lambda p: p["body"]).alias("bodies"))
    x = x.withColumn("words", F.split(F.array_join("bodies", " "), " "))
    runs = F.when(F.size("words") >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, SHINGLE), " "))).otherwise(F.array())
    short = F.filter("bodies", lambda b: F.size(F.split(b, " ")) < SHINGLE)
    return x.select(*KEYS, "level", F.explode(F.concat(runs, short)).alias("unit")).select(*KEYS, "level", F.xxhash64("unit").alias("hash"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): for each message that quotes, the earlier message of its conversation that it answers.

    A quoted passage belongs to the first message that says it unquoted, however its lines were wrapped: passages meet by the hashes of their runs of five words, lines of fewer as
    a whole (64 bits, compared within a conversation only). Of the messages quoted, those at the outermost level come first, then the one with the most runs, then the latest.
    """
    rows = messages.where(F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    quoting = rows.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quoted = _passages(quoting).where("level > 0").groupBy(*KEYS, "level", "hash").agg(F.count("*").alias("n"))
    wanted = quoted.select("conv", "hash").distinct()
    own = _passages(rows.join(quoting.select("conv").distinct(), "conv", "left_semi")).where("level = 0")
    origin = own.join(wanted, ["conv", "hash"], "left_semi").groupBy("conv", "hash").agg(F.min("turn").alias("parent"))
    hits = quoted.join(origin, ["conv", "hash"]).where("parent < turn").groupBy(*KEYS, "level", "parent").agg(F.sum("n").alias("n"))
    return hits.groupBy(*KEYS).agg(F.max_by("parent", F.struct(-F.col("level"), "n", "parent")).alias("parent"))


def _threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, thread, depth): the first message that a chain of answers leads to, by pointer jumping; rounds grow with the logarithm of the chain."""
    now = saved(links.select(*KEYS, "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "threads")
    while not now.where("moved").isEmpty():
        up = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("top"), F.col("depth").alias("more"))
        joined = now.drop("moved").join(up, ["conv", "thread"], "left")
        new = saved(joined.select(*KEYS, "parent", F.coalesce("top", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")), "threads")
        forget(now)
        now = new
    return now.drop("moved")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: conv_col, turn_col, role_col, body, parent_turn, thread_turn, depth, position, n_quoted.

    body is the text without quotes; parent_turn the message answered (null if it quotes none); thread_turn the first message of its chain of answers;
    position is the number of its conversation's messages before it in reply order: threads by their first message, an answer after what it answers.

    Positions come from counts of turns, and those from counts of blocks of threads and of turns, so neither a conversation nor a turn with a third of all messages meets in one task.
    A null text has a null body. Rows with a null conversation or turn link to nothing and have no position. Messages that share a conversation and
    turn, repeated rows too, share a position. Empty texts stay empty. Other columns aren't returned.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), text.alias("text"))
    threads = _threads(quote_links(rows))
    known = rows.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).groupBy(*KEYS).agg(F.count("*").alias("n"))
    turns = known.join(threads, KEYS, "left").withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))
    turns = turns.withColumn("tb", F.floor(F.col("thread") / BLOCK)).withColumn("mb", F.floor(F.col("turn") / BLOCK))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[0]).orderBy(*keys[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = turns.groupBy("conv", "tb", "thread", "mb").agg(F.sum("n").alias("n"))
    coarse = fine.groupBy("conv", "tb").agg(F.sum("n").alias("n")).select("conv", "tb", before(["conv"], ["tb"]).alias("base"))
    fine = fine.select("conv", "tb", "thread", "mb", before(["conv", "tb"], ["thread", "mb"]).alias("near")).join(coarse, ["conv", "tb"])
    within = turns.withColumn("in", before(["conv", "thread", "mb"], ["turn"]))
    placed = within.join(fine.select("conv", "thread", "mb", "near", "base"), ["conv", "thread", "mb"])
    placed = saved(placed.select(F.struct(*KEYS).alias("k"), "n", "parent", "thread", "depth", (F.col("in") + F.col("near") + F.col("base")).cast("long").alias("position")), "places")
    n_quoted = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[ \t]*>"))), F.lit(0)).cast("long")
    x = rows.select("conv", "turn", "role", F.when(F.col("text").isNotNull(), unquoted(F.col("text"))).alias("body"), F.when(F.col("text").isNotNull(), n_quoted).otherwise(0).cast("long").alias("n_quoted"))
    whole = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    out = met_by(x.where(whole).withColumn("k", F.struct(*KEYS)), placed, "k", "n").drop("k", "n")
    out = out.unionByName(x.where(~whole).withColumns({"parent": F.lit(None).cast("long"), "thread": F.col("turn"), "depth": F.lit(0).cast("long"), "position": F.lit(None).cast("long")}))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"), "depth", "position", "n_quoted")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
OP1_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
raw AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM m),
lines AS (SELECT rid, conv_id, turn, line, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]*)+)(.*)$', 1), '[^>]', '', 'g')) AS level,
  {_NORMAL.format(r"CASE WHEN regexp_matches(raw, '^[ \t]*>') THEN regexp_extract(raw, '^[ \t]*((?:>[ \t]*)+)(.*)$', 2) ELSE raw END")} AS body FROM raw),
said AS (SELECT conv_id, turn, level, string_split(string_agg(body, ' ' ORDER BY line), ' ') AS w FROM lines WHERE body <> '' GROUP BY rid, conv_id, turn, level),
units AS (SELECT conv_id, turn, level, unnest(list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))) AS body FROM said
  UNION ALL SELECT conv_id, turn, level, body FROM lines WHERE body <> '' AND len(string_split(body, ' ')) < {SHINGLE}),
q AS (SELECT conv_id, turn, level, body, count(*) AS n FROM units WHERE level > 0 GROUP BY ALL),
o AS (SELECT conv_id, body, min(turn) AS parent FROM units WHERE level = 0 GROUP BY ALL),
h AS (SELECT conv_id, q.turn, level, parent, sum(n) AS n FROM q JOIN o USING (conv_id, body) WHERE parent < q.turn GROUP BY ALL),
k AS (SELECT conv_id, turn, parent FROM h QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent DESC) = 1),
t AS (SELECT conv_id, turn, parent, parent AS thread, 1 AS depth FROM k UNION ALL SELECT t.conv_id, t.turn, t.parent, k.parent, t.depth + 1 FROM t JOIN k ON k.conv_id = t.conv_id AND k.turn = t.thread),
u AS (SELECT conv_id, turn, parent, thread, depth FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1)
SELECT m.conv_id, m.turn, role, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?im)^on [^\n]*wrote:[ \t]*\n([ \t]*>)', '\1', 'g'), '(?m)^[ \t]*>[^\n]*(?:\n|$)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS body,
  parent AS parent_turn, coalesce(thread, m.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth,
  CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN (rank() OVER (PARTITION BY m.conv_id, m.turn IS NULL ORDER BY coalesce(thread, m.turn), m.turn) - 1)::BIGINT END AS position,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*>')))::BIGINT AS n_quoted
FROM m LEFT JOIN u ON u.conv_id = m.conv_id AND u.turn = m.turn
"""
