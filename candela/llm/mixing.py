"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sources, in code-point order with null last, weigh 3, 1, 2 and so on in turn and share
``total`` times the words of all documents; a target stops at ``most`` times its source's own
words and the excess is shared again by weight. With sources sorted by cap / weight this has a
closed form: the common level is the largest (rest of the total) / (rest of the weights).

A document of a source is to be taken target / size times. The whole part is certain; the
fractions are rounded by pivotal steps: of two documents, words move from one to the other, by
chance and without bias, until one has a whole number of copies. The sum of words stays. The
documents of a source are dealt by hash into buckets of about ``FAN``, a bucket folds to one
document that still has a fraction, and the left-over documents of ``FAN`` buckets meet in the
next level of a reduction tree. The last one of a source is rounded to the nearer whole number,
so that a source misses its target by half a document at most. Chance is a hash of the ids and a
seed: reruns agree, whatever the partitioning.

Rows of equal id, source, size and text are counted, and dealt into pieces of ``PIECE`` rows at most. A piece has its
whole copies in common and takes part in the rounding with the one fraction that is left, so neither a repeated row nor
a null id that a third of all rows share fills a bucket.

Null text has size 0 and, like every text without words, takes 0 words. A null source is a
source of its own. Rows of one id with different texts are documents of their own. Empty tables give empty tables. Only id, text and
source are read; :func:`mixed` returns all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, sized, unit_hash, written

WEIGHTS = (3, 1, 2)
FAN = 64
PIECE = 1024


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, docs, source_size, target) of a table (source, size, n), n equal rows each: a row for each source.

    The windows without a partition run over these few rows only.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    return per.select("source", "docs", "source_size", F.least("cap", F.max("level").over(everywhere) * F.col("w")).alias("target"))


#: A piece in the rounding: its hash, its key, rows, words of a row, rows sure of one more copy, words due of one more row.
DOC = ("h", "id", "th", "source", "rows", "base", "sure", "w", "y")


def _step(acc: Column, new: Column) -> Column:
    """One pivotal step: the carried document and the next; y is the words due, of w."""
    old = acc["carry"]
    up = F.least(old["w"] - old["y"], new["y"])  # words that may go from the next to the carried one
    down = F.least(old["y"], new["w"] - new["y"])
    rise = unit_hash(old["h"], new["h"], seed=7) * (up + down) < down
    old_y = F.when(rise, old["y"] + up).otherwise(old["y"] - down)
    new_y = F.when(rise, new["y"] - up).otherwise(new["y"] + down)
    # the bound that was the smaller one made its document whole; if the carried one was whole already, it is done
    old_done = (old["y"] <= 0) | (old["y"] >= old["w"]) | F.when(rise, old["w"] - old["y"] <= new["y"]).otherwise(old["y"] <= new["w"] - new["y"])
    set_y = lambda doc, y: F.struct(*[doc[c].alias(c) for c in DOC[:-1]], y.alias("y"))
    old_end, new_end = set_y(old, old_y), set_y(new, new_y)
    return F.struct(
        F.when(old_done, new_end).otherwise(old_end).alias("carry"),
        F.concat(acc["done"], F.array(F.when(old_done, old_end).otherwise(new_end))).alias("done"),
    )


def _fold(docs: DataFrame) -> DataFrame:
    """Each (source, bucket) folded to its carried document and those that became whole."""
    doc = F.struct(*DOC)
    lists = docs.groupBy("source", "bucket").agg(F.array_sort(F.collect_list(doc)).alias("a"))
    first = F.struct(F.element_at("a", 1).alias("carry"), F.slice("a", 1, 0).alias("done"))
    return lists.select("source", "bucket", F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), first, _step).alias("s"))


def rounded(docs: DataFrame) -> DataFrame:
    """The pieces (DOC) with a fraction due, as (id, th, source, rows, base, sure, w, extra): extra is 0 or 1."""
    whole = F.when(F.col("d.y") * 2 >= F.col("d.w"), 1).otherwise(0)
    shown = lambda df: df.select(*[F.col(f"d.{c}") for c in DOC[1:-1]], whole.alias("extra"))
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("buckets", F.ceil(F.col("n") / FAN)).select(F.col("source").alias("__source"), "buckets")
    counts = written(counts)
    n, largest = counts.agg(F.count(F.lit(1)), F.coalesce(F.max("buckets"), F.lit(0))).first()
    level = docs.join(sized(counts, n), docs["source"].eqNullSafe(F.col("__source")))
    level = level.withColumn("bucket", F.pmod("h", "buckets")).select("source", "bucket", *[c for c in DOC if c != "source"])
    out = None
    while True:
        folded = written(_fold(level))
        done = shown(folded.select(F.explode("s.done").alias("d")))
        out = done if out is None else out.unionByName(done)
        if largest <= 1:
            return out.unionByName(shown(folded.select(F.col("s.carry").alias("d"))))
        largest = math.ceil(largest / FAN)
        level = folded.select("source", F.expr(f"bucket div {FAN}").alias("bucket"), *[F.col(f"s.carry.{c}").alias(c) for c in DOC if c != "source"])


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")))


def piece_plan(df: DataFrame, id_col: str, text: str, source: str, total: float, most: float) -> DataFrame:
    """(id, th, source, size, source_size, target, rows, base, more): of ``rows`` equal rows ``more`` are taken base + 1 times, the others base times."""
    key = ["id", "th", "source", "size"]
    sizes = written(df.select(F.col(id_col).alias("id"), text_hash(text).alias("th"), F.col(source).alias("source"), n_words(text).alias("size")).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    targets = written(source_targets(sizes, total, most))
    n = targets.count()
    named = targets.select(F.col("source").alias("__source"), "source_size", "target")
    each = sizes.join(sized(named, n), sizes["source"].eqNullSafe(F.col("__source"))).drop("__source")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}")))
    each = each.withColumn("piece", piece).withColumn("rows", F.least(F.lit(PIECE).cast("long"), F.col("n") - F.col("piece") * PIECE))
    each = each.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    each = each.withColumn("base", F.floor(F.col("ratio") + 1e-9)).withColumn("due", F.greatest(F.col("ratio") - F.col("base"), F.lit(0.0)) * F.col("rows"))
    each = each.withColumn("sure", F.when(F.col("size") > 0, F.floor(F.col("due") + 1e-9)).otherwise(0).cast("long")).withColumn("due", F.col("due") - F.col("sure"))
    each = each.withColumn("w", F.col("size").cast("double")).withColumn("y", F.greatest(F.col("due") * F.col("size"), F.lit(0.0))).withColumn("h", F.xxhash64(F.lit(11), "id", "th", "piece", "w"))
    fractional = (F.col("due") > 1e-9) & (F.col("size") > 0)
    open_ = rounded(each.where(fractional).select(*DOC))
    open_ = open_.select("id", "th", "source", F.col("w").cast("long").alias("size"), "rows", "base", (F.col("sure") + F.col("extra")).alias("more"))
    plan = each.where(~fractional).select("id", "th", "source", "size", "rows", "base", F.col("sure").alias("more")).unionByName(open_)
    plan = plan.join(sized(named, n), plan["source"].eqNullSafe(F.col("__source")))
    return plan.select(*key, "source_size", "target", "rows", "base", "more")


def mix_plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): how often each row of ``df`` is taken."""
    with scratch(df.sparkSession) as keep:
        plan = keep(piece_plan(df, id_col, text, source, total, most))
    copies = F.when(F.col("k") <= F.col("more"), F.col("base") + 1).otherwise(F.col("base")).cast("long")
    rows = plan.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).withColumn("copies", copies)
    return rows.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``df``, each as often as the plan takes it. All columns are shuffled once, by id, text and source.

    Of rows equal in these three of which only some get one copy more, the rows equal in all columns are counted, and the
    counts dealt the copies in the order of a hash of the row: so many as the plan says, whatever the partitioning.
    Columns of such rows must be of types that Spark can group (no maps).
    """
    key = {"__id": "id", "__th": "th", "__source": "source"}
    with scratch(df.sparkSession) as keep:
        plan = piece_plan(df, id_col, text, source, total, most).groupBy(*key.values()).agg(F.max("base").alias("__base"), F.sum("rows").alias("__rows"), F.sum("more").alias("__more"))
        plan = keep(plan.where("__base > 0 OR __more > 0").select(*[F.col(c).alias(k) for k, c in key.items()], "__base", "__rows", "__more"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("__text", text_hash(text))
    met = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")) & F.col(f"`{source}`").eqNullSafe(F.col("__source"))
    some = (F.col("__more") > 0) & (F.col("__more") < F.col("__rows"))

    def repeated(table: DataFrame, copies: Column) -> DataFrame:
        return table.withColumn("__k", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*columns)

    out = repeated(rows.join(plan.where(~some), met), F.col("__base") + (F.col("__more") > 0).cast("long"))
    split = plan.where(some)
    n = split.count()
    if n:
        alike = rows.join(sized(split, n), met).groupBy(*columns, *key, "__base", "__more").agg(F.count(F.lit(1)).alias("__n"))
        order = Window.partitionBy(*key).orderBy(F.xxhash64(*columns), F.hash(*columns)).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("__n").over(order), F.lit(0))
        extra = F.least(F.greatest(F.col("__more") - before, F.lit(0)), F.col("__n"))
        out = out.unionByName(repeated(alike.withColumn("__copies", F.col("__base") * F.col("__n") + extra), F.col("__copies")))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
