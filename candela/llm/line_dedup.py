"""Deletion of repeated line runs: suffix array over line-ID sequences by distributed prefix doubling.

Lines with a word are the letters of a text's sequence; an id is a 128-bit hash of the bytes. Texts that occur in
several documents are collapsed to their first document before anything else, so groups of copies cost nothing.

Up: the suffixes are sorted by their first line, then by their first 2, 4, 8 .. lines. The rank of a suffix at 2w is the
place of its pair (rank at w, rank w lines further on) among all such pairs in order. Only pairs that occur twice are
ranked: they are the longest-common-prefix intervals of depth 2w, and a suffix outside of them repeats nothing of
that length and leaves. It ends when no interval is left, after log2(longest repeat) rounds.

Down: an interval of any depth is named by its depth and its first suffix in document order. From the deepest level
on, each interval is split by the rank of the next 2^k lines behind its depth; parts of two suffixes or more are
intervals of their own, 2^k deeper, and their first suffix stays in the parent too, whose other suffixes may yet share
less with it. So for every suffix the deepest interval is found in which it is not the first one: the length of its
longest match with an earlier place. Runs that a longer one of the line before contains are not maximal and go.

Later copies of every maximal run of ``min_words`` words or more are deleted (1: of every run, as the query and the
pipeline have it). Order is doc_id (null first, as the smallest long), then text hash, then line. Nothing holds a group
together: pairs and intervals are counted by partial aggregation, and joined in a way that Spark can split.

Lines without words never count and go only if a deleted run holds them between its lines. Null texts have no
lines and stay null; bytes that are no UTF-8 come out as U+FFFD. Rows that repeat both id and text are one document: none of them is a copy of the other.
Empty tables give empty tables. Other columns pass through; columns n_lines and n_removed of the input are replaced
by :func:`dedup_lines` and kept by :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, scratch, written

#: The id that stands for a null one.
NO_ID = -(1 << 63)
#: A document: its id and a hash of its text.
DOC = ["d", "t"]


def split_lines(text: bytes) -> tuple[list[bytes], list[int]]:
    """The lines that have a word, and which of all lines they are."""
    every = text.split(b"\n")
    at = [i for i, x in enumerate(every) if x and not x.isspace()]
    return [every[i] for i in at], at


def _doc_id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def _text_hash(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c.cast("binary"), F.lit("").cast("binary")))


PACKED = T.StructType([T.StructField("d", T.LongType()), T.StructField("t", T.LongType()), T.StructField("text_id", T.BinaryType()), T.StructField("lines", T.ArrayType(T.BinaryType()))])


def packed(docs: DataFrame) -> DataFrame:
    """(d, t, text_id, lines): hashes of the text and of its lines with words, of a table (d, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for text in batch.column(2):
                raw = text.as_py() or b""
                lines, _ = split_lines(raw)
                texts.append(hashlib.blake2b(raw, digest_size=16).digest())
                hashes.append([hashlib.blake2b(x, digest_size=16).digest() for x in lines])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary()), pa.array(hashes, pa.list_(pa.binary()))], names=PACKED.fieldNames())

    return docs.select("d", "t", F.col("text").cast("binary").alias("text")).mapInArrow(run, PACKED)


def place() -> Column:
    return F.struct(*DOC, "pos")


def intervals(pairs: DataFrame, *key: str) -> DataFrame:
    """The keys that two suffixes (d, t, pos) or more share, in order: (key, rank, f); f is the first suffix.

    A row for each key, so the sort deals out no frequent one to a single task. Written, so that the rows of a
    frequent key can be split in the join behind it.
    """
    found = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("f")).where("n > 1").select(*key, "f")
    return written(found.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()))


def ranked(lines: DataFrame) -> list[DataFrame]:
    """For each k the suffixes (d, t, pos, rank, f) whose first 2^k lines occur elsewhere too. Needs (d, t, pos, name)."""
    classes = intervals(lines, "name")
    levels = [written(lines.join(classes, "name").select(*DOC, "pos", "rank", "f"))]
    discard(classes)
    while True:
        w = 1 << (len(levels) - 1)
        ahead = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(w, w)
        pairs = levels[-1].select(*DOC, "pos", F.col("rank").alias("r1"), F.first("rank").over(ahead).alias("r2")).where("r2 IS NOT NULL")
        classes = intervals(pairs, "r1", "r2")
        if classes.isEmpty():
            discard(classes)
            return levels
        levels.append(written(pairs.join(classes, ["r1", "r2"]).select(*DOC, "pos", "rank", "f")))
        discard(classes)


def matches(levels: list[DataFrame]) -> DataFrame:
    """(d, t, pos, len): the longest match of each suffix with an earlier place, where there is one."""
    rows = None  # suffixes in the intervals to split, (d, t, pos, len, f): an interval is its depth and its first suffix
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if rows is not None:
            behind = level.select(*DOC, F.col("pos").alias("at"), "rank")
            met = written(rows.withColumn("at", F.col("pos") + F.col("len")).join(behind, [*DOC, "at"], "left").drop("at"))
            parts = met.where("rank IS NOT NULL").groupBy("len", "f", "rank").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first")).where("n > 1").drop("n")
            here, deeper = F.struct("len", "f"), F.struct((F.col("len") + (1 << k)).alias("len"), F.col("first").alias("f"))
            both = F.when(F.col("first").isNull(), F.array(here)).when(place() == F.col("first"), F.array(here, deeper)).otherwise(F.array(deeper))
            rows = met.join(written(parts), ["len", "f", "rank"], "left").select(*DOC, "pos", F.explode(both).alias("x")).select(*DOC, "pos", "x.len", "x.f")
        own = level.select(*DOC, "pos", F.lit(1 << k).alias("len"), "f")
        if k + 1 < len(levels):  # those that match an earlier place at twice the length are under way
            longer = levels[k + 1].where(place() != F.col("f")).select(*DOC, "pos")
            own = own.join(longer, [*DOC, "pos"], "left_anti")
        rows = own if rows is None else rows.unionByName(own)
    return rows.where(place() != F.col("f")).groupBy(*DOC, "pos").agg(F.max("len").alias("len"))


def maximal_runs(texts: DataFrame) -> DataFrame:
    """(d, t, pos, len) of a table (d, t, lines) of different texts: the maximal runs that match an earlier place."""
    lines = texts.select(*DOC, F.posexplode("lines").alias("pos", "name"))
    found = matches(ranked(lines))
    before = F.lag(F.struct("pos", "len")).over(Window.partitionBy(*DOC).orderBy("pos"))
    inside = (F.col("b.pos") == F.col("pos") - 1) & (F.col("b.len") > F.col("len"))
    return found.withColumn("b", before).where(F.col("b").isNull() | ~inside).drop("b")


def repeats(docs: DataFrame) -> DataFrame:
    """(d, t, copy, runs): what a table (d, t, text) repeats of earlier documents or of itself; a row for each document that does.

    ``copy``: the whole text is that of an earlier document. Else ``runs`` has the maximal runs (pos, len).
    """
    every = written(packed(docs).where("size(lines) > 0"))
    texts = written(every.groupBy("text_id").agg(F.min("d").alias("d"), F.max("d").alias("last"), F.any_value("t").alias("t"), F.any_value("lines").alias("lines")))
    often = texts.where("last > d").select("text_id", F.col("d").alias("own"))
    copies = every.join(often, "text_id").where("d > own").select(*DOC).distinct()
    runs = maximal_runs(texts).groupBy(*DOC).agg(F.collect_list(F.struct("pos", "len")).alias("runs"))
    none = F.lit(None).cast("array<struct<pos:int,len:int>>")
    return runs.select(*DOC, F.lit(False).alias("copy"), F.col("runs").cast("array<struct<pos:int,len:int>>").alias("runs")).unionByName(copies.select(*DOC, F.lit(True).alias("copy"), none.alias("runs")))


def cut(text: bytes, runs: list[dict] | None, copy: bool, min_words: int) -> tuple[bytes, int, int]:
    """The text without the runs of ``min_words`` words, how many of its lines with words are gone, and how many it had."""
    every = text.split(b"\n")
    at = [i for i, x in enumerate(every) if x and not x.isspace()]
    if copy:
        runs = [{"pos": 0, "len": len(at)}]
    if not runs:
        return text, 0, len(at)
    words = np.concatenate(([0], np.cumsum([len(every[i].split()) for i in at])))
    gone, hit = np.zeros(len(every), bool), np.zeros(len(at), bool)
    for r in runs:
        a, b = r["pos"], r["pos"] + r["len"]
        if words[b] - words[a] >= min_words:
            gone[at[a] : at[b - 1] + 1] = True
            hit[a:b] = True
    return b"\n".join([x for x, g in zip(every, gone, strict=True) if not g]), int(hit.sum()), len(at)


def _cut_table(df: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """``df`` with cut texts, and columns __n_lines and __n_removed."""
    keys = {"__d": _doc_id(F.col(id_col)), "__t": _text_hash(F.col(text))}
    with scratch(df.sparkSession) as keep:
        found = keep(repeats(df.select(keys["__d"].alias("d"), keys["__t"].alias("t"), F.col(text).alias("text"))))
    found = found.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("copy").alias("__copy"), F.col("runs").alias("__runs"))
    shown = [F.make_valid_utf8(text).alias(text) if c == text else F.col(f"`{c}`") for c in df.columns]
    joined = df.withColumns(keys).join(found, ["__d", "__t"], "left").select(*shown, "__copy", "__runs")
    counts = ["__n_lines", "__n_removed"]
    schema = T.StructType([df.schema[c] for c in df.columns] + [T.StructField(c, T.LongType()) for c in counts])
    schema[text].nullable = True
    n, place = len(df.columns), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lines, removed = [], [], []
            for x, copy, runs in zip(batch.column(place), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                value = x.as_py()
                left, gone, total = cut(b"" if value is None else value.encode(), runs, bool(copy), min_words)
                own.append(left.decode() if gone else value)
                lines.append(total)
                removed.append(gone)
            cols = list(batch.columns[:n])
            cols[place] = pa.array(own, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*df_columns, *counts])

    df_columns = df.columns
    return joined.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """``df`` with later copies of repeated runs cut from the texts, and columns n_lines and n_removed."""
    out = _cut_table(df.drop("n_lines", "n_removed"), id_col, text, min_words)
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """``df`` with cut texts; documents of which no word is left go. A column n_chars is counted anew."""
    out = _cut_table(df, id_col, text, min_words).where("__n_removed < __n_lines OR __n_removed = 0")
    cols = {c: F.col(f"`{c}`") for c in df.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("__n_removed") > 0, F.length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*cols.values())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))
