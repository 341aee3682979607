"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. A document's set of word shingles is hashed; documents with equal sets form one class, and
   only the class's first document goes on.
2. Each of ``TREES`` trees of the forest sorts the signatures by its own ``DEPTH`` hashes. Signatures next to
   each other in an order whose longest common prefix is 4 hashes or more are compared; those whose estimated
   similarity is not clearly too low join their documents to clusters of candidates.
3. A cluster is dealt into blocks of some ``BLOCK_DOCS`` documents and ``BLOCK_SHINGLES`` shingles, and ``PIVOTS`` of its
   documents go to all its blocks. In a block all pairs are verified on the full sets. So a large group of
   near copies becomes one component in linear time.
4. What may be left are links between different components. In each order the documents with a common prefix
   form a region; its depth adapts to its size: 4 hashes up to ``SMALL`` documents, else 5, and where that is still
   more than ``MIDDLE`` documents, 6. Regions of one component are done. In others every document outside of the
   region's largest component is compared with all of another component, by signature; where the estimate is not clearly
   too low, the document is sent to the block of the other one.
5. Blocks verify the documents sent to them on the full sets. Connected components of all links are the classes.

Nothing is capped. A pair of similarity 0.85 shares no region of 24 trees with probability 2e-8 (depth 4) to 1.2e-5
(depth 6), one of 0.8 with 6e-6 to 7e-4; two documents that other links connect need no region at all.

No task holds more than a block and as many documents sent to it, or two blocks of signatures. Null and empty texts have empty sets and stand alone. Fewer words than a
shingle make one shingle of the whole sequence. Rows of a repeated id are linked by their
sets like others: a document is its id and the hash of its text, what is compared are numbered sets. Rows without an id
stand alone, with a null component. Other columns are ignored or passed through. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import scratch, written
from .components import components, sorted_groups, spanning

TREES, DEPTH = 24, 6
SMALL, MIDDLE = 32, 512
REGION_BLOCK = 1024
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 256, 200_000, 16
#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Similar:
    """Documents are linked if 100 * shared >= percent * united ``width``-word shingles."""

    width: int = 5
    percent: int = 80

    @property
    def screen(self) -> float:
        """Estimates below this are 4.75 standard deviations under the threshold."""
        j = self.percent / 100
        return j - 4.75 * sqrt(j * (1 - j) / (TREES * DEPTH))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(2 * TREES * DEPTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
    k = W.mix(k)
    return k[::2] | np.uint64(1), k[1::2]


SIGNED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "th", "n", "f1", "f2")]
    + [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("deeper", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())]
)


def _signed(sets: list[np.ndarray]) -> list[pa.Array]:
    """n, f1, f2, prefix, deeper and sig of each set."""
    n = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(n)
    f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    sign = np.zeros((len(full), TREES * DEPTH), np.uint64)
    if len(full):
        flat = np.concatenate([sets[k] for k in full])
        first = np.cumsum(n[full]) - n[full]
        f1[full] = np.add.reduceat(W.mix(flat), first)
        f2[full] = np.add.reduceat(W.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
        for j, (a, c) in enumerate(zip(*_permutations(), strict=True)):
            sign[:, j] = np.minimum.reduceat((flat ^ c) * a, first)
    by_tree = sign.reshape(len(full), TREES, DEPTH)
    prefix = np.zeros((len(full), TREES), np.uint64) + np.arange(TREES, dtype=np.uint64)
    for k in range(4):
        prefix = W.mix(prefix * np.uint64(31) + by_tree[:, :, k])
    deeper = (by_tree[:, :, 4] >> np.uint64(32) << np.uint64(32)) | (by_tree[:, :, 5] >> np.uint64(32))
    sig = ((sign >> np.uint64(20)) & np.uint64(0xFF)).astype(np.uint8)
    has = np.zeros(len(sets), np.int32)
    has[full] = 1
    at = np.concatenate(([0], np.cumsum(has))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at * TREES), pa.array(x.reshape(-1).view(np.int64))) for x in (prefix, deeper)]
    raw = pa.array([sig[at[k]].tobytes() if has[k] else b"" for k in range(len(sets))], pa.binary())
    return [pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *lists, raw]


def _batch_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for i, j, data, off in W.chunks(column, CHUNK):
        yield i, j, W.shingle_sets(W.LOWER[data], off, width)


def signatures(docs: DataFrame, how: Similar) -> DataFrame:
    """Signature rows of a table (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _batch_sets(batch.column(2), how.width):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(2)], *_signed(sets)], names=SIGNED.fieldNames())

    return docs.select(F.col("doc_id").cast("long"), "th", F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _edges_of(batches: Iterator[pa.RecordBatch], near) -> Iterator[pa.RecordBatch]:
    """Spanning edges of every group (keys: three longs; then the id and what ``near`` needs)."""
    a, b, held = [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    for group in sorted_groups(batches, 3):
        if len(group) < 2:
            continue
        ids = group.column(3).to_numpy()
        u, v = spanning(near(group))
        if len(u):
            a.append(ids[u])
            b.append(ids[v])
            held += len(u)
        if held > 50_000:
            yield flush()
            a, b, held = [], [], 0
    if held:
        yield flush()


def _similar(a: np.ndarray, b: np.ndarray, screen: float) -> np.ndarray:
    """Whether the estimated similarity of each signature of ``a`` and each of ``b`` reaches the screen."""
    size = a.shape[1]
    least = size * (screen + (1 - screen) / 256)  # bytes also agree by chance
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, 4_000_000 // (max(len(b), 1) * size))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] == b[None, :, :]).sum(-1) >= least
    return out


def _sigs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), TREES * DEPTH)


def forest(signed: DataFrame) -> DataFrame:
    """(k4, m6, set_id, n4): the places of signatures in the orders of all trees, where n4 > 1 share the first 4 hashes.

    k4 stands for the tree and those 4 hashes; m6 orders by the next two (32 bits each).
    """
    places = signed.select("set_id", F.explode(F.arrays_zip("prefix", "deeper")).alias("t")).select(F.col("t.prefix").alias("k4"), F.col("t.deeper").alias("m6"), "set_id")
    often = written(places.groupBy("k4").agg(F.count(F.lit(1)).alias("n4")).where("n4 > 1"))
    return written(places.join(often, "k4"))


def neighbour_edges(places: DataFrame, sigs: DataFrame, how: Similar) -> DataFrame:
    """(a, b): documents next to each other in an order, with 4 common hashes or more, that may be similar."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = (batch.column(k).to_numpy() for k in (0, 1))
            if last is not None:
                key, ids = np.concatenate((last[0], key)), np.concatenate((last[1], ids))
            last = key[-1:], ids[-1:]
            same = key[1:] == key[:-1]
            a, b = ids[:-1][same], ids[1:][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    order = ("k4", "m6", "set_id")
    met = places.repartitionByRange(*order).sortWithinPartitions(*order).select("k4", "set_id").mapInArrow(pairs, EDGE).distinct()
    side = lambda c: sigs.select(F.col("set_id").alias(c), F.col("sig").alias(f"sig_{c}"))
    screen = how.screen

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sigs(batch.column(k)) for k in (2, 3))
            near = pa.array((x == y).sum(1) >= x.shape[1] * (screen + (1 - screen) / 256))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in (0, 1)], names=["a", "b"])

    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(similar, EDGE)


def _linked(group: pa.Table, percent: int) -> np.ndarray:
    """Whether each two sets are linked, by exact counts."""
    lists = group.column(4).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    value = np.asarray(lists.flatten())
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    name = np.cumsum(new) - 1
    often = np.bincount(name)[name] > 1
    name, owner = name[often], owner[often]
    _, name = np.unique(name, return_inverse=True)
    shared = np.zeros((len(size), len(size)))
    step = max(256, 8_000_000 // max(len(size), 1))
    for low in range(0, int(name.max()) + 1 if len(name) else 0, step):
        part = (name >= low) & (name < low + step)
        incidence = np.zeros((len(size), min(step, int(name.max()) + 1 - low)), np.float32)
        incidence[owner[part], name[part] - low] = 1
        shared += incidence @ incidence.T
    return 100 * shared >= percent * (size[:, None] + size[None, :] - shared)


SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def firsts_of(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, doc_id, th): the document that stands for each set of a table (id)."""
    return classes.join(ids, classes["set_id"] == ids["id"], "left_semi").select(F.col("set_id").alias("id"), F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))


def shingles_of(docs: DataFrame, firsts: DataFrame, how: Similar) -> DataFrame:
    """(id, shingles) of the documents (id, doc_id, th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _batch_sets(batch.column(1), how.width):
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "th", F.col("text").cast("binary").alias("text"))
    return texts.join(firsts, ["doc_id", "th"]).dropDuplicates(["id"]).select("id", "text").mapInArrow(run, SETS)


def blocks_of(places: DataFrame, clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, root, block, blocks, docs) for each document of the forest: its block in its cluster, or one of its own."""
    sized = clusters.join(classes.select(F.col("set_id").alias("id"), "n"), "id")
    size = sized.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    size = written(size.select("root", "docs", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")))
    inside = clusters.join(size, "root").select("id", "root", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "blocks", "docs")
    alone = places.select(F.col("set_id").alias("id")).distinct().join(clusters, "id", "left_anti")
    return inside.unionByName(alone.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), F.lit(1).cast("long").alias("docs")))


def _verified(dealt: DataFrame, how: Similar) -> DataFrame:
    """Spanning edges of the links in each group (three longs) of a table (three longs, id, shingles)."""
    keys, percent = dealt.columns[:3], how.percent
    groups = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return groups.mapInArrow(lambda batches: _edges_of(batches, lambda g: _linked(g, percent)), EDGE)


def block_edges(members: DataFrame, sets: DataFrame, how: Similar) -> DataFrame:
    """Spanning edges of the links inside each block of a cluster, its pivots included."""
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(5), "id"), "docs") < PIVOTS)
    at = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = members.where("docs > 1").select("root", F.explode(at).alias("block"), F.lit(0).cast("long").alias("part"), "id")
    return _verified(dealt.join(sets, "id").select("root", "block", "part", "id", "shingles"), how)


def regions(places: DataFrame) -> DataFrame:
    """(region, set_id): regions of the depth that their size asks for."""
    small = places.where(F.col("n4") <= SMALL).select(F.xxhash64(F.lit(4), "k4").alias("region"), "set_id")
    deep = places.where(F.col("n4") > SMALL).withColumn("m5", F.shiftrightunsigned("m6", 32))
    n6 = deep.groupBy("k4", "m5", "m6").agg(F.count(F.lit(1)).alias("n6"))
    n5 = n6.groupBy("k4", "m5").agg(F.sum("n6").alias("n5"))
    depth = written(n6.join(n5, ["k4", "m5"]).where("n5 > 1").select("k4", "m6", F.when(F.col("n5") <= MIDDLE, F.xxhash64(F.lit(5), "k4", "m5")).when(F.col("n6") > 1, F.xxhash64(F.lit(6), "k4", "m6")).alias("region")))
    return small.unionByName(deep.join(depth, ["k4", "m6"]).where("region IS NOT NULL").select("region", "set_id"))


REQUEST = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "root", "block")])


def requests(places: DataFrame, comps: DataFrame, members: DataFrame, sigs: DataFrame, how: Similar) -> DataFrame:
    """(id, root, block): documents that may be similar to one of another component, with the block that holds it."""
    comp = comps.select(F.col("id").alias("set_id"), F.col("root").alias("comp"))
    rows = written(regions(places).join(comp, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id")))
    each = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c"))
    info = each.groupBy("region").agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    up = lambda n: F.ceil(n / REGION_BLOCK)
    info = written(info.select("region", F.col("top.comp").alias("main"), up(F.col("n")).alias("parts"), up(F.col("n") - F.col("top.c")).alias("asks")))
    open_ = rows.join(info, "region").withColumn("minor", (F.col("comp") != F.col("main")).cast("long"))
    open_ = open_.join(sigs, "set_id").join(members.select(F.col("id").alias("set_id"), "root", "block"), "set_id")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    rest = ("set_id", "comp", "minor", "root", "block", "sig")
    asked = open_.select("region", F.explode(count("asks")).alias("ask"), F.pmod(F.xxhash64("set_id"), "parts").alias("part"), F.lit(0).cast("long").alias("asks"), *rest)
    asking = open_.where("minor = 1").select("region", F.pmod(F.xxhash64(F.lit(1), "set_id"), "asks").alias("ask"), F.explode(count("parts")).alias("part"), F.lit(1).cast("long").alias("asks"), *rest)
    keys, screen = ("region", "ask", "part"), how.screen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for group in sorted_groups(batches, 3):
            kind, ids, comp, minor, root, block = (group.column(k).to_numpy() for k in range(3, 9))
            q, p = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            if not len(q) or not len(p):
                continue
            differ = (comp[q][:, None] != comp[p][None, :]) & ((minor[p] == 0)[None, :] | (ids[q][:, None] < ids[p][None, :]))
            differ &= (root[q][:, None] != root[p][None, :]) | (block[q][:, None] != block[p][None, :])
            if not differ.any():
                continue
            sig = _sigs(group.column(9))
            near = _similar(sig[q], sig[p], screen) & differ
            if not near.any():
                continue
            # a document asks for a block once, however many of its documents are near
            order = np.lexsort((block[p], root[p]))
            r, b = root[p][order], block[p][order]
            first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (b[1:] != b[:-1]))))
            i, j = np.nonzero(np.logical_or.reduceat(near[:, order], first, axis=1))
            out.append(np.stack([ids[q][i], r[first][j], b[first][j]]))
            held += len(i)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=REQUEST.fieldNames())
                out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=REQUEST.fieldNames())

    return asked.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, REQUEST).distinct()


def request_edges(asks: DataFrame, members: DataFrame, docs: DataFrame, classes: DataFrame, sets: DataFrame, how: Similar) -> DataFrame:
    """Spanning edges of the links between the documents of blocks and those sent there. ``sets`` has most of them already."""
    held = written(asks.groupBy("root", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts")))
    sent = asks.join(held, ["root", "block"]).select("root", "block", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id")
    there = members.select("id", "root", "block").join(held, ["root", "block"]).select("root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id")
    dealt = written(sent.unionByName(there))
    more = written(dealt.select("id").distinct().join(sets, "id", "left_anti"))
    if not more.isEmpty():
        # written, so that its size is known: a small one is broadcast instead of shuffling the texts
        sets = sets.unionByName(written(shingles_of(docs, written(firsts_of(classes, more)), how)))
    return _verified(dealt.join(sets, "id").select("root", "block", "part", "id", "shingles"), how)


def set_components(docs: DataFrame, classes: DataFrame, distinct: DataFrame, how: Similar) -> DataFrame:
    """(set_id, root): the component of each set that is linked with another one."""
    sigs = distinct.select("set_id", "sig")
    places = forest(distinct)
    clusters = components(neighbour_edges(places, sigs, how))
    members = written(blocks_of(places, clusters, classes))
    near = written(shingles_of(docs, firsts_of(classes, clusters.select("id")), how))
    first = components(block_edges(members, near, how))
    asks = written(requests(places, first, members, sigs, how))
    comp = first.select(F.col("id").alias("set_id"), F.col("root").alias("comp"))
    if asks.isEmpty():
        return comp.withColumnRenamed("comp", "root")
    edges = request_edges(asks, members, docs, classes, near, how)
    for c in ("a", "b"):
        edges = edges.join(comp.select(F.col("set_id").alias(c), F.col("comp").alias(f"c_{c}")), c, "left").withColumn(c, F.coalesce(f"c_{c}", c)).drop(f"c_{c}")
    last = components(edges).select(F.col("id").alias("comp"), "root")
    joined = comp.join(last, "comp", "left").select("set_id", F.coalesce("root", "comp").alias("root"))
    alone = last.join(comp.select(F.col("set_id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("set_id"), "root")
    return joined.unionByName(alone)


def _text_hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text.cast("binary")), F.lit(0))


def _judged(df: DataFrame, id_col: str, text: str, how: Similar) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept, first_of_class), one row for each row of ``df``."""
    docs = df.select(F.col(id_col).alias("doc_id"), _text_hash(F.col(text)).alias("th"), F.col(text).alias("text"))
    signed = written(signatures(docs, how))
    set_key = ["n", "f1", "f2"]
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy(*set_key).agg(F.min(F.struct("doc_id", "th")).alias("rep"))
    classes = written(classes.withColumn("set_id", F.monotonically_increasing_id()))  # fixed, since it is written
    firsts = classes.select("rep.doc_id", "rep.th", *set_key, "set_id")
    distinct = written(signed.join(firsts, ["doc_id", "th", *set_key]).dropDuplicates(["set_id"]).select("set_id", "prefix", "deeper", "sig"))
    roots = set_components(docs, classes, distinct, how)
    placed = written(classes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
    first = written(placed.groupBy("root").agg(F.min("rep").alias("first")))
    of_class = placed.join(first, "root").select(*set_key, "first")
    out = signed.select("doc_id", "th", *set_key).join(of_class, set_key, "left")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(own, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.when(own, F.struct("doc_id", "th") == F.struct("first.doc_id", "first.th")).otherwise(F.lit(True)).alias("first_of_class"),
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", how: Similar | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, first_of_class), one row for each row of ``df``.

    kept: doc_id = component_id. Where several texts have one id, first_of_class marks the one that stands for the class.
    """
    with scratch(df.sparkSession) as keep:
        return keep(_judged(df, id_col, text, how or Similar()).drop("th"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", how: Similar | None = None) -> DataFrame:
    """The rows of ``df`` that are the first of their class."""
    with scratch(df.sparkSession) as keep:
        gone = keep(_judged(df, id_col, text, how or Similar()).where("NOT first_of_class").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    return df.join(gone, (df[id_col] == F.col("__id")) & (_text_hash(df[text]) == F.col("__th")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, how=Similar(width=3, percent=85))
