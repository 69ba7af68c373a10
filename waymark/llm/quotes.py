"""Quotation linking, in DataFrame functions only.

Quoted passages of messages (runs of lines behind the same number of >) are
normalised and hashed, and joined to the first message of the conversation that
says the passage unquoted. A message replies to the message whose passages it
quotes at its outermost level; conversations come out in reply order, thread by
thread, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from waymark.llm.common import table, written

#: The line that introduces a quotation, in some languages; a fixed pattern.
INTRODUCES = r"^[^>]{0,300}\b(?:wrote|writes|said|schrieb|a écrit|escribió)[^:>\n]{0,80}:\s*$"
#: Rounds of pointer jumping: threads of 2^60 replies.
JUMPS = 60


def _level(line: Column) -> Column:
    """The number of > before the line's text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[> \t]*", 0), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.substr(line, F.length(F.regexp_extract(line, r"^[> \t]*", 0)) + 1)


def _blank(line: Column) -> Column:
    return F.coalesce(F.trim(_body(line)) == "", F.lit(False))


def normalised(passage: Column) -> Column:
    """Lower case, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[^\p{L}\p{N}]+", " "))


def units(block: Column) -> Column:
    """The paragraphs of a text, and their lines, as structs (paragraph, unit)
    of normalised texts; those without letters and digits are left out."""
    paragraphs = F.filter(F.split(block, r"\n[ \t]*\n[ \t\n]*"), lambda p: normalised(p) != "")
    of = F.transform(paragraphs, lambda p: F.transform(F.array_union(F.array(normalised(p)), F.transform(F.split(p, "\n"), normalised)), lambda u: F.struct(normalised(p).alias("paragraph"), u.alias("unit"))))
    return F.array_distinct(F.filter(F.flatten(of), lambda s: s["unit"] != ""))


def parsed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with lines, the level of each, and the
    text without quotes and what introduces them (own; as it is where the
    message quotes nothing)."""
    rows = rows.withColumn("lines", F.split("text", r"\r?\n")).withColumn("levels", F.transform("lines", _level))

    def own(line: Column, at: Column) -> Column:
        def quoted(i: Column) -> Column:
            return F.coalesce(F.get("levels", i) > 0, F.lit(False))

        after = quoted(at + 1) | (_blank(F.get("lines", at + 1)) & quoted(at + 2))
        return F.when((F.get("levels", at) == 0) & ~(line.rlike(INTRODUCES) & after), line)

    left = F.array_join(F.filter(F.transform("lines", own), lambda x: x.isNotNull()), "\n")
    has = F.exists("levels", lambda n: n > 0)
    return rows.withColumn("own", F.when(has, F.btrim(left, F.lit(" \t\r\n"))).otherwise(F.col("text")))


def passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, paragraph, unit) of the quotes of parsed rows."""
    levels = rows.select("conv_id", "turn", "lines", "levels", F.explode(F.array_distinct(F.filter("levels", lambda n: n > 0))).alias("level"))
    block = F.array_join(F.transform("lines", lambda line, at: F.when(F.get("levels", at) == F.col("level"), _body(line)).otherwise("")), "\n")
    return levels.select("conv_id", "turn", "level", F.explode(units(block)).alias("u")).select("conv_id", "turn", "level", "u.*")


def replies(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_quotes, n_linked) of the messages that quote,
    given parsed rows: a quote's source is the first message of the conversation
    that says it, if that is an earlier one. reply_to is the source of most
    letters at the outermost level that has a source; of equals, the latest."""
    rows = rows.where("conv_id is not null and turn is not null")
    quoting = rows.where(F.exists("levels", lambda n: n > 0))
    quotes = written(passages(quoting).select("conv_id", "turn", "level", F.md5("paragraph").alias("paragraph"), F.md5("unit").alias("unit"), F.length("unit").alias("n")).distinct(), "quotes")
    talks = quotes.select("conv_id").distinct()
    said = rows.join(talks, "conv_id", "left_semi").select("conv_id", "turn", F.explode(units(F.regexp_replace("own", "\r", ""))).alias("u"))
    # written, so that the join deals both sides anew and can split a passage that is quoted often
    first = written(said.groupBy("conv_id", F.md5("u.unit").alias("unit")).agg(F.min("turn").alias("source")), "first")
    linked = quotes.join(first, ["conv_id", "unit"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    by_paragraph = linked.groupBy("conv_id", "turn", "level", "paragraph", "source").agg(F.sum("n").alias("n"))
    by_source = by_paragraph.where("source is not null").groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = by_source.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"))
    one = by_paragraph.groupBy("conv_id", "turn", "level", "paragraph").agg(F.max(F.col("source").isNotNull().cast("int")).alias("linked"))
    counts = one.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.sum("linked").alias("n_linked"))
    return counts.join(best, ["conv_id", "turn"], "left")


def threads(found: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn) of the messages that reply: the message that
    their chain of replies begins with, by pointer jumping."""
    up = written(found.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("thread_turn")), "threads")
    for _ in range(JUMPS):
        above = up.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("above"))
        if up.join(above, ["conv_id", "thread_turn"], "left_semi").isEmpty():
            return up
        up = written(up.join(above, ["conv_id", "thread_turn"], "left").select("conv_id", "turn", F.coalesce("above", "thread_turn").alias("thread_turn")), "threads")
    raise RuntimeError("the replies form a circle")


def positions(rows: DataFrame) -> DataFrame:
    """rows with their position within conv_id by thread_turn, turn, role and
    text. Rows are dealt by ranges of that order, so a conversation of any
    length is spread over tasks; a range adds the sizes of the ranges before it."""
    order = ["conv_id", "thread_turn", "turn", "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(sizes.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    own = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order[1:]))
    return placed.withColumn("position", (F.col("before") + own - 1).cast("long")).drop("part", "before")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread_turn,
    position) for every row of conversations (conv_id, turn, role, text): the text
    without quotes, how many quoted passages it had and how many of them have a
    source, the turn it replies to (null: none is known), the turn that its
    thread begins with (its own, if it replies to none), and its place in the
    conversation, from 0: by threads, then turns, so replies follow.

    Messages without a conversation or a turn have null for the last three and
    no links. A null text stays null. Rows that repeat a turn are one message for
    links (the passages of all count) and stay rows, in order of role and text.
    Other columns are not looked at; an empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ready = parsed(rows)
    found = written(replies(ready), "replies")
    out = ready.select("conv_id", "turn", "role", F.col("own").alias("text")).join(found, ["conv_id", "turn"], "left").join(threads(found), ["conv_id", "turn"], "left")
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    counted = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quotes", "n_linked")]
    out = out.select("conv_id", "turn", "role", "text", *counted, "reply_to", F.when(whole, F.coalesce("thread_turn", "turn")).alias("thread_turn"))
    placed = positions(out.where(whole))
    return placed.unionByName(out.where(~whole), allowMissingColumns=True).select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread_turn", "position")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations
), cut AS (
  SELECT id, conv_id, turn, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m WHERE text IS NOT NULL
), lines AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^[> \t]*'), '[^>]', '', 'g')) AS level,
    substr(line, len(regexp_extract(line, '^[> \t]*')) + 1) AS body FROM cut
), seen AS (
  SELECT *, lead(level, 1, 0) OVER w AS l1, lead(level, 2, 0) OVER w AS l2, lead(trim(body), 1, 'x') OVER w AS b1
  FROM lines WINDOW w AS (PARTITION BY id ORDER BY i)
), kept AS (
  SELECT *, level = 0 AND NOT (regexp_matches(line, '^[^>]{0,300}\b(?:wrote|writes|said|schrieb|a écrit|escribió)[^:>\n]{0,80}:\s*$') AND (l1 > 0 OR (b1 = '' AND l2 > 0))) AS own FROM seen
), texts AS (
  SELECT id, CASE WHEN max(level) > 0 THEN trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (own), ''), ' ' || chr(9) || chr(13) || chr(10)) END AS own_text
  FROM kept GROUP BY id
), clean AS (
  SELECT m.*, coalesce(own_text, text) AS own FROM m LEFT JOIN texts USING (id)
), said_lines AS (
  SELECT id, conv_id, turn, 0 AS level, unnest(string_split(replace(own, chr(13), ''), chr(10))) AS body, generate_subscripts(string_split(replace(own, chr(13), ''), chr(10)), 1) AS i FROM clean WHERE own IS NOT NULL
), all_lines AS (
  SELECT *, trim(regexp_replace(lower(body), '[^\pL\pN]+', ' ', 'g')) AS unit, trim(body, ' ' || chr(9)) = '' AS gap FROM (
    SELECT id, conv_id, turn, level, body, i FROM lines WHERE level > 0 UNION ALL SELECT id, conv_id, turn, level, body, i FROM said_lines)
), runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM all_lines WHERE NOT gap
), paragraphs AS (
  SELECT id, conv_id, turn, level, run, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[^\pL\pN]+', ' ', 'g')) AS paragraph FROM runs GROUP BY ALL
), units AS (
  SELECT DISTINCT * FROM (
    SELECT conv_id, turn, level, paragraph, paragraph AS unit FROM paragraphs
    UNION ALL SELECT p.conv_id, p.turn, p.level, paragraph, unit FROM paragraphs p JOIN runs r USING (id, level, run))
  WHERE paragraph <> '' AND unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), first AS (
  SELECT conv_id, unit, min(turn) AS source FROM units WHERE level = 0 GROUP BY ALL
), linked AS (
  SELECT u.*, CASE WHEN f.source < u.turn THEN f.source END AS source FROM units u LEFT JOIN first f USING (conv_id, unit) WHERE level > 0
), sums AS (
  SELECT conv_id, turn, level, source, sum(len(unit)) AS n FROM linked WHERE source IS NOT NULL GROUP BY ALL
), best AS (
  SELECT conv_id, turn, source AS reply_to FROM sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1
), counts AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(*) FILTER (has) AS n_linked
  FROM (SELECT conv_id, turn, level, paragraph, bool_or(source IS NOT NULL) AS has FROM linked GROUP BY ALL) GROUP BY ALL
), chain AS (
  SELECT conv_id, turn, reply_to AS above FROM best
  UNION SELECT c.conv_id, c.turn, b.reply_to FROM chain c JOIN best b ON b.conv_id = c.conv_id AND b.turn = c.above
), roots AS (SELECT conv_id, turn, min(above) AS root FROM chain GROUP BY ALL),
done AS (
  SELECT c.conv_id, c.turn, c.role, c.own AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to,
    CASE WHEN c.conv_id IS NOT NULL THEN coalesce(root, c.turn) END AS thread_turn
  FROM clean c LEFT JOIN counts USING (conv_id, turn) LEFT JOIN best USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn)
)
SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY thread_turn, turn, role, text) - 1 END AS position FROM done
"""
