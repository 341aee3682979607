r"""Chat formatting with quotation linking.

Lines that begin with ``>`` are quoted, as many levels deep as they have such marks. A passage is a run of adjacent lines
of one level, up to an empty one; normalised, it is lower case with white space as single blanks, so that its line breaks
do not matter. Quoted passages are hashed and joined with the passages that messages of the conversation say
themselves; the nearest earlier message that says it is the origin. A passage that nobody said as a whole is linked by its
sentences and lines, each on its own. A message answers the origin that most lines of its outermost linked level
come from (the latest of equals); without a link it answers the message before it (the next lower turn, whatever the gap), if there is one.

From the answers each message gets its thread (the turn of the message that began it) and its depth in it, by pointer
doubling over the keys (conv_id, turn): log2(depth) joins, each of the conversations that are as deep. Result: a row for each message, without quotes and without the
attribution line above a quote, as chat text. ``query`` sorts the rows by conversation, thread, depth and turn, which puts
every message behind the one it answers: files hold whole conversations in reply order, a very long one is split by range.

The nearest earlier message is found by a running maximum inside of ``SPAN`` turns, and one over the spans, so a passage that
a third of all rows repeat fills no group. Null texts count as empty, null roles are ``unknown``; messages without
conversation or turn answer nothing. Repeated rows stay repeated, with equal results; different rows of one turn are one
message for links. Other columns are ignored, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, written

MARKS = r"^((?:[ \t]*>)+)"
#: How mail programs introduce a quote, in the languages at hand.
ATTRIBUTION = r"^[ \t]*(?:On|Am|Le|El) .*(?:wrote|schrieb|écrit|escribió).*:[ \t]*$"
SENTENCE = r"[^.!?]+[.!?]*"
SPAN = 1024


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def is_attribution(lines: Column, x: Column, i: Column) -> Column:
    """Whether a line is the attribution directly above a quote."""
    return x.rlike(ATTRIBUTION) & F.coalesce(level(F.get(lines, i + 1)) > 0, F.lit(False))


def own_lines(lines: Column) -> Column:
    """Lines that are neither quoted nor the attribution directly above a quote."""
    return F.filter(lines, lambda x, i: (level(x) == 0) & ~is_attribution(lines, x, i))


def quotes(lines: str) -> Column:
    return F.exists(lines, lambda x: F.ltrim(x).startswith(">") | (level(x) > 0))


def with_passages(df: DataFrame) -> DataFrame:
    """``df``, which has ``lines``, with ``passages``: array of (level, lines, text, units)."""
    item = lambda x, i: F.struct(F.when(is_attribution(F.col("lines"), x, i), -1).otherwise(level(x)).alias("level"), normal(x).alias("text"))
    df = df.withColumn("items", F.transform("lines", item))
    at = lambda i: F.get("items", i)
    says = lambda i: F.coalesce((at(i)["text"] != "") & (at(i)["level"] >= 0), F.lit(False))
    joined = lambda i, j: says(i) & says(j) & (at(i)["level"] == at(j)["level"])
    every = F.sequence(F.lit(0), F.size("items") - 1)
    df = df.withColumn("starts", F.filter(every, lambda i: says(i) & ~joined(i, i - 1))).withColumn("ends", F.filter(every, lambda i: says(i) & ~joined(i, i + 1)))
    part = lambda a, b: F.transform(F.slice("items", a + 1, b - a + 1), lambda x: x["text"])
    df = df.withColumn("parts", F.zip_with("starts", "ends", lambda a, b: F.struct(at(a)["level"].alias("level"), part(a, b).alias("lines"))))
    df = df.withColumn("joint", F.transform("parts", lambda p: F.struct(p["level"].alias("level"), p["lines"].alias("lines"), F.array_join(p["lines"], " ").alias("text"))))
    units = lambda p: F.array_distinct(F.filter(F.concat(p["lines"], F.transform(F.regexp_extract_all(p["text"], F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))), lambda u: u != ""))
    shaped = lambda p: F.struct(p["level"].alias("level"), F.size(p["lines"]).alias("lines"), p["text"].alias("text"), units(p).alias("units"))
    return df.withColumn("passages", F.transform("joint", shaped)).drop("items", "starts", "ends", "parts", "joint")


def nearest(said: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, hash, turn, origin): for each (conv_id, hash, turn) of ``asked`` the latest earlier turn of ``said``."""
    key = ["conv_id", "hash"]
    said = said.join(asked.select(*key).distinct(), key, "left_semi").distinct()
    both = asked.distinct().select(*key, "turn", F.lit(None).cast("long").alias("by")).unionByName(said.select(*key, "turn", F.col("turn").alias("by")))
    both = both.withColumn("span", F.floor(F.col("turn") / SPAN))
    near = Window.partitionBy(*key, "span").orderBy("turn", F.asc_nulls_first("by")).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(both.groupBy(*key, "span").agg(F.max("by").alias("by")).select(*key, "span", F.max("by").over(far).alias("before")))
    found = both.withColumn("inside", F.max("by").over(near)).where("by IS NULL").join(spans, [*key, "span"])
    return found.select(*key, "turn", F.coalesce("inside", "before").alias("origin")).where("origin IS NOT NULL")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, origin, n_linked) for the messages (conv_id, turn, lines) that quote an earlier one.

    Only conversations that have a quote are taken apart.
    """
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "lines")
    with_quotes = written(known.where(quotes("lines")).select("conv_id").distinct())
    # outer: for a plain explode Spark would derive a filter on the array, and make the passages once more for it
    each = with_passages(known.join(with_quotes, "conv_id", "left_semi")).select("conv_id", "turn", F.explode_outer("passages").alias("p")).where("p IS NOT NULL")
    each = written(each.withColumn("hash", F.sha2(F.col("p.text"), 256)))
    said = each.where("p.level = 0").select("conv_id", "turn", F.explode(F.concat(F.array("hash"), F.transform("p.units", lambda u: F.sha2(u, 256)))).alias("hash"))
    quoted = each.where("p.level > 0").select("conv_id", "turn", F.col("p.level").alias("depth"), F.col("hash").alias("passage"), F.col("p.lines").cast("long").alias("lines"), "hash", F.col("p.units").alias("units"))
    whole = quoted.select("conv_id", "turn", "depth", "passage", F.lit(1).alias("whole"), "lines", "hash")
    parts = quoted.select("conv_id", "turn", "depth", "passage", F.lit(0).alias("whole"), F.lit(1).cast("long").alias("lines"), F.explode(F.transform("units", lambda u: F.sha2(u, 256))).alias("hash"))
    asks = written(whole.unionByName(parts).distinct())
    met = asks.join(nearest(said, asks.select("conv_id", "hash", "turn")), ["conv_id", "hash", "turn"])
    best = F.max("whole").over(Window.partitionBy("conv_id", "turn", "depth", "passage"))
    met = met.withColumn("best", best).where("whole = best")
    votes = met.groupBy("conv_id", "turn", "depth", "passage", "origin").agg(F.sum("lines").alias("n"))
    votes = votes.groupBy("conv_id", "turn", "depth", "origin").agg(F.sum("n").alias("n"), F.collect_set("passage").alias("passages"))
    top = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("outer"), "n", "origin")).alias("b"), F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("passages", lambda h: F.struct("depth", h)))))).cast("long").alias("n_linked"))
    return top.select("conv_id", "turn", F.col("b.origin").alias("origin"), "n_linked")


def threads(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of a table (conv_id, turn, reply_to) of different keys."""
    now = written(answers.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("thread"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    done: list[DataFrame] = []
    while True:
        up = now.where("depth > 0").select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        met = now.join(up, ["conv_id", "thread"], "left")
        after = written(met.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved")))
        open_ = written(after.where("moved").select("conv_id").distinct())
        after = after.drop("moved")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done, after)
        # only conversations that are not at their roots yet go on
        done.append(after.join(open_, "conv_id", "left_anti"))
        now = after.join(open_, "conv_id", "left_semi")


def with_previous(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, previous) of different keys (conv_id, turn): the turn before, whatever the gap; split by spans of turns."""
    turns = turns.withColumn("span", F.floor(F.col("turn") / SPAN))
    inside, over = Window.partitionBy("conv_id", "span").orderBy("turn"), Window.partitionBy("conv_id").orderBy("span")
    spans = turns.groupBy("conv_id", "span").agg(F.max("turn").alias("last"))
    spans = written(spans.select("conv_id", "span", F.lag("last").over(over).alias("before")))
    return turns.withColumn("inside", F.lag("turn").over(inside)).join(spans, ["conv_id", "span"]).select("conv_id", "turn", F.coalesce("inside", "before").alias("previous"))


def chat(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, thread, depth, n_quoted, n_linked, text, message) for each message."""
    base = df.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    keys = ["conv_id", "turn"]
    with scratch(df.sparkSession) as keep:
        links = written(linked(base))
        turns = base.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*keys).distinct()
        answers = written(with_previous(turns).join(links, keys, "left").select(*keys, F.coalesce("origin", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")))
        placed = keep(answers.join(threads(answers.select(*keys, "reply_to")), keys))
    text = F.trim(F.regexp_replace(F.concat_ws("\n", own_lines(F.col("lines"))), r"\n{3,}", "\n\n"))
    quoted = with_passages(base.withColumn("text", text).withColumn("lines", F.when(quotes("lines"), F.col("lines")).otherwise(F.array().cast("array<string>"))))
    said = quoted.select(*keys, "role", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"), "text")
    return said.join(placed, keys, "left").select(
        *keys, "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>")).alias("message"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return chat(spark.read.parquet(f"{sf_dir}/conversations.parquet")).orderBy("conv_id", "thread", "depth", "turn")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, COALESCE(role, 'unknown') AS role, string_split(COALESCE(text, ''), chr(10)) AS lines FROM conversations),
x AS (SELECT r, conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM m),
y AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS lev, trim(lower(regexp_replace(regexp_replace(line, '^((?:[ \t]*>)+)', ''), '\s+', ' ', 'g'))) AS t FROM x),
z AS (SELECT *, regexp_matches(line, '^[ \t]*(?:On|Am|Le|El) .*(?:wrote|schrieb|écrit|escribió).*:[ \t]*$') AND COALESCE(LEAD(lev) OVER (PARTITION BY r ORDER BY i), 0) > 0 AS attribution FROM y),
g AS (SELECT *, SUM(CASE WHEN lev = before AND NOT attribution AND NOT attribution_before AND t <> '' AND t_before <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (
  SELECT *, LAG(lev) OVER w AS before, LAG(t) OVER w AS t_before, LAG(attribution) OVER w AS attribution_before FROM z WINDOW w AS (PARTITION BY r ORDER BY i))),
p AS (SELECT r, conv_id, turn, lev, string_agg(t, ' ' ORDER BY i) AS p, list(t) AS ts FROM g WHERE t <> '' AND NOT attribution GROUP BY r, conv_id, turn, lev, g),
u AS (SELECT *, list_distinct(list_filter(list_concat(ts, list_transform(regexp_extract_all(p, '[^.!?]+[.!?]*'), lambda s: trim(s))), lambda s: s <> '')) AS us FROM p WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (SELECT DISTINCT conv_id, turn, unnest(list_append(us, p)) AS h FROM u WHERE lev = 0),
asks AS (SELECT DISTINCT conv_id, turn, lev, p, 1 AS whole, len(ts) AS lines, p AS h FROM u WHERE lev > 0 UNION SELECT DISTINCT conv_id, turn, lev, p, 0, 1, unnest(us) FROM u WHERE lev > 0),
met AS (SELECT a.*, (SELECT MAX(s.turn) FROM said s WHERE s.conv_id = a.conv_id AND s.h = a.h AND s.turn < a.turn) AS origin FROM asks a),
won AS (SELECT * FROM met WHERE origin IS NOT NULL QUALIFY whole = MAX(whole) OVER (PARTITION BY conv_id, turn, lev, p)),
v AS (SELECT conv_id, turn, lev, origin, SUM(lines) AS n FROM won GROUP BY ALL),
b AS (SELECT conv_id, turn, FIRST(origin ORDER BY lev, n DESC, origin DESC) AS origin FROM v GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, COUNT(DISTINCT (lev, p)) AS n_linked FROM won GROUP BY conv_id, turn),
k AS (SELECT conv_id, turn, LAG(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
a AS (SELECT k.conv_id, k.turn, COALESCE(b.origin, k.previous) AS reply_to, COALESCE(n_linked, 0) AS n_linked
  FROM k LEFT JOIN b USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)),
tree AS (SELECT conv_id, turn, turn AS thread, CAST(0 AS BIGINT) AS depth FROM a WHERE reply_to IS NULL
  UNION ALL SELECT a.conv_id, a.turn, tree.thread, tree.depth + 1 FROM a JOIN tree ON a.conv_id = tree.conv_id AND a.reply_to = tree.turn),
own AS (SELECT r, trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS text FROM z WHERE lev = 0 AND NOT attribution GROUP BY r)
SELECT m.conv_id, m.turn, role, reply_to, COALESCE(thread, m.turn) AS thread, COALESCE(depth, 0) AS depth,
  (SELECT COUNT(*) FROM p WHERE p.r = m.r AND lev > 0) AS n_quoted, CAST(COALESCE(n_linked, 0) AS BIGINT) AS n_linked, COALESCE(own.text, '') AS text, '<|' || role || '|>' || chr(10) || COALESCE(own.text, '') || '<|end|>' AS message
FROM m LEFT JOIN own USING (r) LEFT JOIN a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN tree ON tree.conv_id = m.conv_id AND tree.turn = m.turn
"""
