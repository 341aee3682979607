"""Exact top-k by integer inner product over a bit-sliced index.

Components are quantised to floor(scale * x). Rows are dealt into blocks; in a block, bit b of
dimension d is one bitmap over its rows. :func:`built` makes these slices once for each block and writes them; a block
is one row of the index. The scores of a query are made for all rows of a
block at once by bitmap arithmetic: for each set bit of a query component the slices of that
dimension (complemented for a negative component, which only shifts all scores) are added at
their weight with carry-save adders. The sums are themselves bit slices; the top rows are found
from the most significant slice downward, and rows tied at the boundary are resolved exactly,
by smaller id. The scores of the few rows chosen are read off the same slices.

The stated queries meet all rows in blocks: a group is (a block of the index, some chunks of queries), both
bounded in bytes (some 16 MB and ``LANE_BYTES``, whatever the width); a block is sent once for every lane of queries, and
queries travel in the narrowest integers that hold them. The winners of the blocks, k a query and block, are then
ranked by query.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id. An id names one row and one query: of several vectors under an id the smallest counts (compared component
by component), so repeated rows change nothing. The row with the query's id is not its candidate. Shorter vectors
count as padded with zeros. Components are quantised to at most ``LARGEST`` in size. If a score could leave 64 bits, scores are added up and
ranked as decimals of 38 digits (exact for vectors of up to 4,096 components), and only the result column ends at the bounds of 64 bits. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written
from .components import sorted_groups

#: Rows of a block at most (fewer for wide vectors, so that slices stay under some 16 MB), queries of a chunk and bytes of it
#: at most, bytes of the chunks that share a copy of a block.
BLOCK_ROWS, BLOCK_BITS, CHUNK_QUERIES, CHUNK_BYTES, LANE_BYTES = 32_768, 1 << 27, 2_048, 1 << 20, 1 << 26
#: The largest component after quantising: two such ones and their products with 4,096 others have 38 digits.
LARGEST = 1 << 56


def quantised(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): one row for each id, v as longs."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def limits(rows: DataFrame) -> tuple[int, int, float, float]:
    """Number of rows, widest vector, largest component, largest sum of components, both without sign."""
    size = lambda v: F.abs(v.cast("double"))
    most = F.max(F.array_max(F.transform("v", size)))
    total = F.max(F.aggregate("v", F.lit(0.0), lambda a, v: a + size(v)))
    return tuple(rows.agg(F.count(F.lit(1)), *[F.coalesce(c, F.lit(0)) for c in (F.max(F.size("v")), most, total)]).first())


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    """A bitmap of 64-bit words, row 0 in the lowest bit."""
    raw = np.packbits(bits, bitorder="little")
    return np.concatenate((raw, np.zeros(-len(raw) % 8, np.uint8))).view(np.uint64)


class Slices:
    """The bit slices of one block of rows."""

    def __init__(self, n: int, low: np.ndarray, bits: np.ndarray, planes: np.ndarray):
        self.n, self.low, self.bits, self.planes = n, low, bits, planes
        ends = np.cumsum(bits).tolist()
        self.plain = [planes[e - b : e] for e, b in zip(ends, bits.tolist(), strict=True)]
        self.all = pack(np.ones(n, bool))

    @classmethod
    def of(cls, rows: np.ndarray) -> Slices:
        low = rows.min(axis=0)
        x = rows - low
        bits = np.array([int(m).bit_length() for m in x.max(axis=0)], np.int64)
        words = -(-len(rows) // 64)
        planes = [pack((x[:, d] >> b) & 1 == 1) for d in range(x.shape[1]) for b in range(bits[d])]
        return cls(len(rows), low, bits, np.array(planes, np.uint64).reshape(-1, words))

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of each row's inner product with the query, up to a constant of the block."""
        total: list = []
        spare: list = []

        def add(level: int, plane: np.ndarray) -> None:
            while True:
                while level >= len(total):
                    total.append(None)
                    spare.append(None)
                if total[level] is None:
                    total[level] = plane
                    return
                if spare[level] is None:
                    spare[level] = plane
                    return
                a, b = total[level], spare[level]
                u = a ^ b
                total[level], spare[level] = u ^ plane, None
                u &= plane
                u |= a & b
                level, plane = level + 1, u

        for d, q in enumerate(query.tolist()):
            slices, q = (self.plain[d], q) if q >= 0 else (~self.plain[d], -q)
            shift = 0
            while q:
                if q & 1:
                    for b, plane in enumerate(slices):
                        add(b + shift, plane)
                q >>= 1
                shift += 1
        level = 0
        while level < len(total):
            if spare[level] is not None:
                a, b = total[level], spare[level]
                total[level], spare[level] = a ^ b, None
                add(level + 1, a & b)
            level += 1
        return [np.zeros_like(self.all) if t is None else t for t in total]

    def top(self, query: np.ndarray, k: int, without: int | None, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows; among equal scores the first rows. ``without``: a row not to consider; ``wide``: scores may leave 64 bits."""
        sure = np.zeros_like(self.all)
        open_ = self.all.copy()
        if without is not None:
            open_[without >> 6] &= ~(np.uint64(1) << np.uint64(without & 63))
        sums = self.scores(query)
        for s in reversed(sums):
            high = open_ & s
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                open_ = high
            else:
                sure |= high
                open_ &= ~s
                if n == k:
                    open_[:] = 0
                    break
        some = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little", count=self.n))
        ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little", count=self.n))
        at = np.concatenate((some, ties[: k - len(some)]))
        negative = query < 0
        kind = object if wide else np.int64  # of any size, or of 64 bits
        query, low, top = query.astype(kind), self.low.astype(kind), (1 << self.bits[negative].astype(kind)) - 1
        score = np.full(len(at), int((query * low).sum() + (query[negative] * top).sum()), kind)
        for b, s in enumerate(sums):
            score += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(kind) << b
        return at, score


INDEX = T.StructType([T.StructField("block", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("ids", "low", "bits", "planes")])
CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("values", T.BinaryType())])


def _packed(dealt: DataFrame, schema: T.StructType, width: int, made) -> DataFrame:
    """One row for each group (the first column) of a table (group, id, v), of the bytes that ``made`` gives for its ids and matrix."""
    group = dealt.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, 1):
            cells = made(rows.column(1).to_numpy(), matrix(rows.column(2), width))
            yield pa.RecordBatch.from_arrays([pa.array([rows.column(0)[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in cells]], names=schema.fieldNames())

    return dealt.repartition(group).sortWithinPartitions(group, "id").mapInArrow(run, schema)


def built(rows: DataFrame, blocks: int, width: int, kind: str) -> DataFrame:
    """The index of quantised rows, written: a row for each block, with its ids in order and its slices."""

    def made(ids: np.ndarray, x: np.ndarray):
        s = Slices.of(x)
        return ids, s.low, s.bits, s.planes

    return written(_packed(rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", F.col("v").cast(kind).alias("v")), INDEX, width, made))


def best_of_block(index: pa.Table, chunks: pa.Table, k: int, wide: bool, stored: str) -> pa.Table:
    """The k best rows of one block for each query of some chunks, whose values are ``stored`` as such integers."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    if len(index) and len(chunks):
        ids, low, bits = (np.frombuffer(index[c][0].as_py(), np.int64) for c in ("ids", "low", "bits"))
        index = Slices(len(ids), low, bits, np.frombuffer(index["planes"][0].as_py(), np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64)))
        for own, values in zip(chunks["ids"].to_pylist(), chunks["values"].to_pylist(), strict=True):
            own = np.frombuffer(own, np.int64)
            for q, v in zip(own.tolist(), np.frombuffer(values, stored).reshape(len(own), -1), strict=True):
                v = v.astype(np.int64)
                a = int(np.searchsorted(ids, q))
                at, score = index.top(v, k, a if a < len(ids) and ids[a] == q else None, wide)
                for o, x in zip(out, (np.full(len(at), q), ids[at], score), strict=True):
                    o.append(x)
    kinds = [pa.int64(), pa.int64(), pa.decimal128(38, 0) if wide else pa.int64()]
    values = [np.concatenate(o).tolist() if wide else np.concatenate(o) for o in out]
    if wide:
        values[2] = [Decimal(x) for x in values[2]]
    return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("query_id", "vec_id", "score"), values, kinds, strict=True)})


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of highest inner product, ties to the smaller id."""
    rows, queries = quantised(rows, id_col, vector, scale), quantised(queries, id_col, vector, scale)
    (n, size, most, _), (m, size_q, most_q, total) = limits(rows), limits(queries)
    wide, kind = total * most >= 2**62, "array<int>" if max(most, most_q) < 2**31 else "array<long>"
    width = max(size, size_q, 1)
    blocks = max(1, math.ceil(n / min(block_rows, max(64, BLOCK_BITS // (12 * width)))))
    stored = next(f"i{b}" for b in (2, 4, 8) if max(most, most_q) < 2 ** (8 * b - 1))
    row_bytes = int(stored[1]) * width
    chunk_queries = max(1, min(chunk_queries, CHUNK_BYTES // row_bytes))
    chunks = max(1, math.ceil(m / chunk_queries))
    lanes = max(math.ceil(m * row_bytes / LANE_BYTES), min(chunks, math.ceil(64 / blocks)))
    index = built(rows, blocks, width, kind)
    asked = written(_packed(queries.select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(chunks)).alias("chunk"), "id", F.col("v").cast(kind).alias("v")), CHUNK, width, lambda ids, x: (ids, x.astype(stored))))
    sent = index.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    dealt = asked.withColumn("lane", F.col("chunk") % lanes).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, k, wide, stored)

    found = sent.groupBy("block", "lane").cogroup(dealt.groupBy("block", "lane")).applyInArrow(best, f"query_id long, vec_id long, score {'decimal(38,0)' if wide else 'long'}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-(2**63))), F.lit(2**63 - 1)).cast("long").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


SQL = """
WITH e AS (
  SELECT vec_id, MIN(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
