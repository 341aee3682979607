r"""Benchmark decontamination by winnowed fingerprints.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased. A *window* is ``WINDOW`` consecutive words of an
item; an item of fewer words is one window of its own. A document's words inside any occurrence of a window are hit.

* Winnowing: of the k-grams in a window the one of least hash is its fingerprint (the last of equal ones). A window of the
  corpus with the same words picks the same k-gram at the same place, so documents keep only the least hash of each sliding
  window, and no shared span of ``WINDOW`` words is missed: k = ``GRAM``, sliding over WINDOW - k + 1 k-grams. Shorter items are
  winnowed the same way over their own length; there are WINDOW lengths at most.
* A bit table over the hashes of the benchmark's fingerprints, 16 bits for each, ``MOST_BITS`` at most, goes to the tasks that
  read the documents; fingerprints it does not hold stay there. What it holds by chance the join sorts out, so a
  larger benchmark costs more rows, but no result.
* Extension: a document's fingerprint carries the words of its window, and is joined with the benchmark's windows on both.
  Equal hashes of other words are so told apart. Adjoining windows make one span; a document's spans are joined in order.
* The join is by broadcast if the benchmark's windows were counted to be few (``common.BROADCAST_ROWS``), else by
  shuffle, where Spark splits a hot fingerprint's documents.
* Which items: windows that occur in the same items are one class (told by count and two sums of hashes of ids), documents
  that hit the same classes one group. Only the different (group, item) pairs are made, so thousands of documents
  with one passage, or a passage in thousands of items, cost one set.

Null, empty and word-less texts of either table have no words, no windows, no hits. Rows of one item_id are one item; a null
item_id is an item of its own, shown as an empty string, first. Rows that repeat doc_id and text give equal rows each; an empty benchmark or
table gives documents without hits, or none. Bytes that are no UTF-8 count as U+FFFD. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import scratch, sized, written

WINDOW, GRAM = 10, 5
#: The bit table has 16 bits a fingerprint, and this many (8 MB) at most.
MOST_BITS = 1 << 26
#: Bytes of words: digits, a-z, and all of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


def _gram(length: int) -> int:
    return min(GRAM, length)


def fingerprints(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, place of its k-gram) of every window of ``length`` words inside a document."""
    k = _gram(length)
    gram = W.mix(W.window_hashes(h, k) + np.uint64(length))
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, place = gram[:n].copy(), np.arange(n)
    for s in range(1, length - k + 1):
        lower = gram[s : s + n] <= least
        least = np.where(lower, gram[s : s + n], least)
        place = np.where(lower, np.arange(s, s + n), place)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(owner[:n] == owner[length - 1 :])
    return whole, least[whole], place[whole]


def _words(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words joined by spaces, where each begins (n+1), their hashes, and each document's first word (n+1)."""
    data = W.LOWER[data]
    starts, ends, first = W.word_spans(data, off, IN_WORD)
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(at[:-1], size) + inside] = data[np.repeat(starts, size) + inside]
    return joined.tobytes(), at, W.word_hashes(data, starts, ends), first


def _utf8(c):
    return F.make_valid_utf8(c).cast("binary")


WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("words", T.BinaryType())])


def windows_of(items: DataFrame) -> DataFrame:
    """(item, length, print, words) of every window of a table (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                joined, at, h, first = _words(data, off)
                size = np.diff(first)
                owner = np.repeat(np.arange(j - i), size)
                for length in range(1, WINDOW + 1):
                    start, print_, _ = fingerprints(h, first, length)
                    if length < WINDOW:
                        use = size[owner[start]] == length
                        start, print_ = start[use], print_[use]
                    names = batch.column(0).slice(i, j - i).take(pa.array(owner[start]))
                    texts = [joined[a : b - 1] for a, b in zip(at[start].tolist(), at[start + length].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(start), length, np.int32)), pa.array(print_.view(np.int64)), pa.array(texts, pa.binary())], names=WINDOWS.fieldNames())

    return items.mapInArrow(run, WINDOWS)


def _bits(prints: DataFrame, count: int) -> np.ndarray:
    """A bit for each fingerprint's hash, in a table of a power of two bits."""
    size = 1 << max(16, (min(MOST_BITS, 16 * count) - 1).bit_length())
    shift = np.uint64(65 - size.bit_length())

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, bool)
        for batch in batches:
            out[batch.column(0).to_numpy().view(np.uint64) >> shift] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for raw in batch.column(0):
                out |= np.frombuffer(raw.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    tables = prints.select("print").mapInArrow(table, "bits binary").repartition(8).mapInArrow(joined, "bits binary")
    return np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in tables.collect()])  # eight tables


FOUND = T.StructType([T.StructField("d", T.LongType()), T.StructField("t", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("pos", T.LongType()), *WINDOWS.fields[1:]])


def candidates(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """Of a table (id, d, t, text): a row (id, d, t, n_words) for each document, and a row (d, t, pos, length, print, words)
    for each of its windows whose fingerprint is in the bit table."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(65 - (len(bits) * 8).bit_length())
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]

            def rows(*columns) -> pa.RecordBatch:
                n = next(len(c) for c in columns if c is not None)
                return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

            for i, j, data, off in W.chunks(batch.column(3)):
                joined, at, h, first = _words(data, off)
                name, d, t = (batch.column(k).slice(i, j - i) for k in range(3))
                yield rows(name, d, t, pa.array(np.diff(first)), None, None, None, None)
                owner = np.repeat(np.arange(j - i), np.diff(first))
                for length in lengths:
                    start, print_, _ = fingerprints(h, first, length)
                    bit = (print_ >> shift).astype(np.int64)
                    use = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    for part in np.array_split(use, len(use) // 10_000 + 1):
                        s, of = start[part], pa.array(owner[start[part]])
                        texts = [joined[x : y - 1] for x, y in zip(at[s].tolist(), at[s + length].tolist(), strict=True)]
                        yield rows(None, d.take(of), t.take(of), None, pa.array(s - first[owner[s]]), pa.array(np.full(len(s), length)), pa.array(print_[part].view(np.int64)), pa.array(texts, pa.binary()))

    return docs.mapInArrow(run, schema)


def _digest(of: str) -> list:
    """Count and two sums of hashes: the same for the same set of values."""
    sums = [F.sum(F.xxhash64(of, F.lit(k)).cast("decimal(20,0)")) for k in (1, 2)]
    return F.sha2(F.concat_ws(",", *[c.cast("string") for c in (F.count(F.lit(1)), *sums)]), 256)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (id, n_words, n_hit, n_items, items) per row of ``docs``, written to the shared folder. items: sorted ids, joined by commas."""
    key, window = ["d", "t"], ["length", "print", "words"]
    with scratch(docs.sparkSession) as kept:
        items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), _utf8(benchmark[item_text]).alias("text"))
        windows = written(windows_of(items).distinct())
        # windows that occur in the same items have one class
        classes = written(windows.groupBy(*window).agg(_digest("item").alias("class")))
        lengths = [r.length for r in classes.select("length").distinct().orderBy("length").collect()]  # WINDOW at most
        count = classes.count()
        value = _utf8(docs[text])
        named = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string")).alias("d"), F.xxhash64(value).alias("t"), value.alias("text"))
        found = written(candidates(named, _bits(classes, count), lengths))
        met = found.where("pos IS NOT NULL").join(sized(classes, count), window)
        hits = written(met.select(*key, "pos", "length", "class").distinct())
        # each document's spans in order: a span counts from where those before it end
        before = Window.partitionBy(*key).orderBy("pos", "length").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("pos") + F.col("length")
        new = F.greatest(F.lit(0), end - F.greatest("pos", F.coalesce(F.max(end).over(before), F.lit(0))))
        n_hit = hits.withColumn("new", new).groupBy(*key).agg(F.sum("new").alias("n_hit"))
        # documents that hit the same classes are one group
        mine = hits.select(*key, "class").distinct()
        group = written(mine.groupBy(*key).agg(_digest("class").alias("group")))
        one = group.groupBy("group").agg(F.min(F.struct(*key)).alias("k")).select("group", "k.d", "k.t")
        of_group, of_class = mine.join(one, key).select("group", "class"), windows.join(classes, window).select("class", "item").distinct()
        listed = of_group.join(of_class, "class").select("group", "item").distinct()
        listed = written(listed.groupBy("group").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
        each = n_hit.join(group.join(listed, "group"), key).select(*key, "n_hit", "n_items", "items")
        out = found.where("pos IS NULL").select("id", *key, "n_words").join(each, key, "left")
        return kept(out.select("id", "n_words", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")], F.coalesce("items", F.lit("")).alias("items")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    out = contaminated(docs, items)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH lower_d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_b AS (
  SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
word_d AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM lower_d),
word_b AS (SELECT r, item, least(len(w), 10) AS m, unnest(w) AS word, unnest(range(len(w))) AS i FROM lower_b),
next_d AS (SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM word_d),
next_b AS (SELECT item, m, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM word_b),
win_b AS (SELECT DISTINCT item, m, array_to_string(l[1:m], ' ') AS words FROM next_b WHERE len(l) >= m),
win_d AS (SELECT r, i, m, array_to_string(l[1:m], ' ') AS words FROM next_d, (SELECT DISTINCT m FROM win_b) WHERE len(l) >= m),
hit AS (SELECT r, i, m, item FROM win_d JOIN win_b USING (m, words)),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
