"""Quality scores by ridge regression on random Fourier features, calibrated isotonically.

Statistics of the whole text (lengths, shares of letters, capitals, digits, symbols, repeats) are
scaled and mapped to random cosines, which approximate a Gaussian kernel. Each partition of
labelled rows sums its normal equations, one system for each of ``FOLDS`` folds; the sums are
added in two levels, so the driver gets a fixed number of small matrices. Subtracting a fold's
sums gives the weights without this fold, hence out-of-fold predictions for all labelled rows at
no further cost; their histogram (``BINS`` bins, pre-aggregated) is calibrated by pooling
adjacent violators. The final weights are fitted on all folds.

All labelled rows are used for learning; there is no sample. Labels other than 0 and 1, null labels, and labels without
a document are ignored; of several labels of one document each counts. Null and empty texts have
zero statistics and get a score like any other. If nothing is labelled all scores are 0.5. Empty
tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import fold, written

FEATURES, GAMMA, RIDGE, FOLDS, BINS = 192, 0.15, 1e-3, 4, 2000
CUT = 0.7

STATS = [
    "log_words", "log_chars", "word_length", "upper", "digit", "symbol", "punct", "exclaim", "wide",
    "distinct_words", "same_as_before", "repeat_lines", "words_a_line", "longest_word", "pipe", "period",
]

_KIND = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&<>@^~_{}[]=+\\/",
    "punct": b",;:.?!'\"()-", "exclaim": b"!", "pipe": b"|", "period": b".", "line": b"\n",
}


def stats_chunk(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of statistics for each document of a chunk."""
    n = len(off) - 1
    starts, ends, first = W.word_spans(data, off)
    h = W.word_hashes(data, starts, ends)
    words = np.diff(first).astype(float)
    size = np.diff(off).astype(float)

    def total_of(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    def count(kind: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(_KIND[kind])] = True
        return total_of(table[data], off)

    chars, some = np.maximum(size, 1), np.maximum(words, 1)
    length = (ends - starts).astype(np.int64)
    distinct, lines_same, lines = np.zeros(n), np.zeros(n), np.zeros(n)
    longest = np.zeros(n)
    raw, bounds = data.tobytes(), off.tolist()
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            distinct[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
            longest[i] = length[a:b].max()
            own = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x]
            lines[i], lines_same[i] = len(own), len(own) - len(set(own))
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    letters = np.maximum(count("upper") + count("lower"), 1)
    return np.column_stack([
        np.log1p(words), np.log1p(size), total_of(length, first) / some,
        count("upper") / letters, count("digit") / chars, count("symbol") / some, count("punct") / some, count("exclaim") / some, total_of(data >= 128, off) / chars,
        distinct / some, total_of(same, first) / some, lines_same / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)), np.log1p(longest), count("pipe") / some, count("period") / some,
    ])


def text_stats(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, x): the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                x = stats_chunk(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["id", "x"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "id long, x array<double>")


class Fourier:
    """Random cosines of scaled statistics; the same for the same scaling."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, gamma: float):
        rng = np.random.default_rng(20)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * gamma / len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])


def normal_equations(labelled: DataFrame, to_features: Fourier, folds: int) -> np.ndarray:
    """Sums of (z, y)' (z, y) by fold for rows (id, x, y): partitions sum first, then groups of partial sums."""
    size = len(to_features.b) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            if len(batch):
                x = np.asarray(batch.column(1).flatten()).reshape(len(batch), -1)
                zy = np.column_stack([to_features(x), np.asarray(batch.column(2))])
                k = np.asarray(batch.column(3))
                for f in range(folds):
                    total[f] += zy[k == f].T @ zy[k == f]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size))
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py()).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = labelled.select("id", "x", "y", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(folds)).alias("fold"))
    tree = rows.mapInArrow(partial, "sums binary").repartition(8).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(r.sums).reshape(folds, size, size) for r in tree.collect()), np.zeros((folds, size, size)))


def solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b = sums[:-1, :-1], sums[:-1, -1]
    penalty = ridge * max(sums[-2, -2], 1.0) * np.eye(len(a))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a + penalty, b)


def pooled(blocks: list[list[float]]) -> list[list[float]]:
    """Adjacent violators pooled: blocks (sum, weight, weighted place) whose means increase."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            g, m, x = out.pop()
            out[-1] = [out[-1][0] + g, out[-1][1] + m, out[-1][2] + x]
    return out


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of an increasing calibration curve over sorted bins.

    Violators are pooled by their rates, each level then shrunk to one half by one row; where that breaks the order of
    small blocks, they are pooled again by their shrunk levels.
    """
    raw = pooled([[g, m, x * m] for x, g, m in zip(at.tolist(), good.tolist(), n.tolist(), strict=True)])
    blocks = pooled([[m * (g + 0.5) / (m + 1), m, x] for g, m, x in raw])
    return np.array([x / m for _, m, x in blocks]), np.array([g / m for g, m, _ in blocks])


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, folds: int = FOLDS, bins: int = BINS):
    """A function from statistics to scores, learned from (id, y) rows; None if there is none."""
    known = labels.where("y IN (0, 1)").select("id", F.col("y").cast("double").alias("y"))
    labelled = written(stats.join(known, "id"))
    width = len(STATS)
    moments = labelled.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}") for i in range(width)], *[F.stddev_pop(f"x{i}") for i in range(width)]).first()
    if not moments[0]:
        return None
    to_features = Fourier(np.array(moments[1 : width + 1], float), np.array(moments[width + 1 :], float), features, gamma)
    sums = normal_equations(labelled, to_features, folds)
    whole = sums.sum(0)
    without = np.array([solve(whole - s, ridge) for s in sums])
    final = solve(whole, ridge)

    @F.pandas_udf("int")
    def bin_of(x: pd.Series, k: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series(np.zeros(0, np.int32))
        raw = (to_features(np.stack(x.to_numpy())) * without[k.to_numpy()]).sum(1)
        return pd.Series(np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype(np.int32))

    held = labelled.select(bin_of("x", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(folds))).alias("bin"), "y")
    table = held.groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    knots, level = isotonic((table["bin"].to_numpy() + 0.5) / bins * 2 - 0.5, table["good"].to_numpy(float), table["n"].to_numpy(float))

    # the curve goes on to 0 and 1 beyond the outermost bins, so that it is monotone and keeps the order there too
    knots, level = np.concatenate(([-1.0], knots, [2.0])), np.concatenate(([0.0], level, [1.0]))

    def score(x: np.ndarray) -> np.ndarray:
        return np.interp(to_features(x) @ final, knots, level)

    return score


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for each row of ``df``; ``labels`` (id, y) are learned from as given."""
    stats = written(text_stats(df, id_col, text))
    score = fit(stats, labels)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(np.round(score(np.stack(x.to_numpy())), 6) if len(x) else np.zeros(0))

    return stats.select("id", F.lit(0.5).alias("score") if score is None else scored("x").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    out = quality_scores(docs, labels.where(fold("id") != 2))
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
