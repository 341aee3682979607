"""Periodic runs: maximal stretches of words that repeat with a short period, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q and a length of at least max(``LEAST``, ``TIMES`` * q) that no
neighbouring word extends keeping period q. A word is dropped if it stands in a run behind the run's first q words.

* Repeated k-gram masking: a run of length n overlaps itself shifted by q in n - q words, which is at least
  k = min over q of max(LEAST, TIMES * q) - q, so every word of a run lies in a k-gram that the document has twice.
  Words outside of such k-grams join no run; what is left falls into segments of consecutive words.
* Main-Lorentz on the segments, all of a chunk of documents at once, level by level: a segment is halved until it is too
  short for a run; a run is found where it first contains the words on both sides of a middle m. Of its at least four
  periods two lie on one side, so words m .. m+q-1 equal the q words behind them, or the q words before m those before them;
  both are compared by hashes of prefixes for every q up to a quarter of the part. How far the period holds in both directions
  is a binary search over the same hashes. Of several periods of one stretch the smallest is its own.
* Words are compared by 64-bit hashes, stretches by two polynomials modulo primes. A found run is then compared word by word
  and byte by byte; a document in which that fails is done again with other numbers for its words, exact ones.

Documents never leave their row: no shuffle. Memory of a task: a batch, worked on in pieces of about 1 MB of text
(a longer text is worked on whole, with some hundred bytes a word). Null, empty and blank texts have no words and no runs.
Rows are taken one by one, so repeated rows give equal results; empty tables give empty ones; columns of the names of results are replaced.
Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Primes below 2^31, and a base for each: prefix hashes of stretches.
PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253))


def least_overlap(least: int, times: int) -> int:
    """The fewest words in which a run overlaps itself shifted by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


class Prefixes:
    """Equality of stretches of a sequence by two polynomial hashes of its prefixes."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.parts = []
        for p, base in PRIMES:
            power = np.ones(self.n + 1, np.uint64)
            done = 1
            while done <= self.n:  # powers up to twice as far in each step
                step = min(done, self.n + 1 - done)
                power[done : done + step] = power[:step] * (int(power[done - 1]) * base % p) % p
                done += step
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids % p) * power[:-1] % p, dtype=np.uint64) % p))
            self.parts.append((np.uint64(p), power, total))

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i on equal those from j on, where i <= j."""
        out = np.ones(len(i), bool)
        for p, power, total in self.parts:
            left = (total[i + size] + p - total[i]) % p * power[j - i] % p
            out &= left == (total[j + size] + p - total[j]) % p
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For how many words the sequence goes on alike from i and from j > i; at least ``least`` are known to be."""
        low, high = least.copy(), self.n - j
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_], j[open_], middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For how many words it is alike before i and before j > i."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_] - middle, j[open_] - middle, middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        return low


def repeated(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document has more than once."""
    n = len(ids)
    out = np.zeros(n + 1, np.int64)
    if n < k:
        return out[:n] > 0
    gram = W.window_hashes(ids, k)
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    whole = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    value = W.mix(gram[whole] ^ W.mix(owner[whole].astype(np.uint64) + np.uint64(1)))  # a collision only lets more words through
    order = np.argsort(value, kind="stable")
    alike = value[order][1:] == value[order][:-1]
    often = np.zeros(len(whole), bool)
    often[order[1:][alike]] = often[order[:-1][alike]] = True
    np.add.at(out, whole[often], 1)
    np.add.at(out, whole[often] + k, -1)
    return np.cumsum(out)[:n] > 0


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, 1 .. counts[which]) for each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def runs_of(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs inside segments [begin, end) of a sequence."""
    size = end - begin
    keep = size >= least
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return np.zeros((0, 3), np.int64)
    # the segments one after the other, each behind a word of its own
    at = np.cumsum(size + 1) - size
    length = int(at[-1] + size[-1]) + 1
    own = np.arange(length, dtype=np.uint64)  # words that occur once
    which, step = _ranges(size)
    source, place = begin[which] + step - 1, at[which] + step - 1
    _, own_ids = np.unique(ids[source], return_inverse=True)
    own[place] = own_ids.astype(np.uint64) + np.uint64(length)
    back = np.zeros(length, np.int64)
    back[place] = source
    same = Prefixes(own)
    found = []
    low, high = at, at + size
    while len(low):
        middle = (low + high) // 2
        which, q = _ranges((high - low) // times)
        m = middle[which]
        for i in (m, m - 2 * q):  # two periods behind the middle, or two before it
            fits = (i >= low[which]) & (i + 2 * q <= high[which])
            i, p, mid = i[fits], q[fits], m[fits]
            like = own[i] == own[i + p]
            i, p, mid = i[like], p[like], mid[like]
            like = same.equal(i, i + p, p)
            i, p, mid = i[like], p[like], mid[like]
            start = i - same.behind(i, i + p)
            stop = i + p + same.ahead(i, i + p, p)
            long_ = (stop - start >= np.maximum(least, times * p)) & (start < mid) & (stop > mid)
            found.append(np.column_stack([start, stop - start, p])[long_])
        # the halves that can hold a run
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
        big = high - low >= least
        low, high = low[big], high[big]
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    out = out[first]
    out[:, 0] = back[out[:, 0]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _confirmed(rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words of each run equal those a period on, byte by byte."""
    which, step = _ranges(rows[:, 1] - rows[:, 2])
    i = rows[which, 0] + step - 1
    j = i + rows[which, 2]
    size = ends[i] - starts[i]
    good = size == ends[j] - starts[j]
    i, j, size, of = i[good], j[good], size[good], which[good]
    word, step = _ranges(size)
    unlike = data[starts[i][word] + step - 1] != data[starts[j][word] + step - 1]
    out = np.ones(len(rows), bool)
    out[which[~good]] = False
    out[of[word[unlike]]] = False
    return out


def runs_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a chunk's documents, by the chunk's word numbers."""
    ids = W.word_hashes(data, starts, ends)

    def search(ids: np.ndarray) -> np.ndarray:
        inside = np.concatenate(([False], repeated(ids, doc, least_overlap(least, times)), [False]))
        first = np.zeros(len(ids) + 1, bool)
        first[doc] = True
        begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        return runs_of(ids, begins, stops, least, times)

    rows = search(ids)
    if len(rows) and not _confirmed(rows, data, starts, ends).all():
        raw, number = data.tobytes(), {}
        ids = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
        rows = search(ids)
        rows = rows[_confirmed(rows, data, starts, ends)]
    return rows


def kept_words(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of n words are in no run behind its first period."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
    np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(gone)[:n] == 0


RUNS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType()),
])


def periodic_runs(df: DataFrame, text: str | Column = "text", keep: list[str] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``keep`` columns (default: all but the text), n_words, runs (by start, then period), and collapsed: the words that are
    kept, joined by one space."""
    if least < 2 or times < 4:
        raise ValueError("a run needs two words and four periods at least")
    names = RUNS.fieldNames()
    keep = [c for c in df.columns if c not in (text, *names)] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + RUNS.fields)
    value = df[text] if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(len(keep))):
                starts, ends, doc = W.word_spans(data, off)
                rows = runs_in(data, starts, ends, doc, least, times)
                use = kept_words(rows, len(starts))
                raw, kept = data.tobytes(), np.concatenate(([0], np.cumsum(use)))[doc].tolist()
                words = [raw[a:b] for a, b in zip(starts[use].tolist(), ends[use].tolist(), strict=True)]
                texts = [b" ".join(words[a:b]).decode() for a, b in zip(kept, kept[1:], strict=False)]
                at = np.searchsorted(rows[:, 0], doc)
                rows[:, 0] -= np.repeat(doc[:-1], np.diff(at))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[: len(keep)]], pa.array(np.diff(doc)), lists, pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.select(*keep, F.make_valid_utf8(value).cast("binary").alias("__text")).mapInArrow(run, schema)


def stretched(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts, by crc32 of the id, with all words from some place on replaced by repeats of the first few of them.

    With h = crc32 of the decimal id, g = h div 10 and n words: where h % 10 = 0 and n > 0, each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id or text stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")  # ANSI mode: no division by zero
    p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(docs, stretched(F.col("doc_id"), F.col("text")), ["doc_id"])
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("best", best)
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
