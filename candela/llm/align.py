"""Alignment of two tokenizers over one corpus, with counts of the id pairs that overlap.

A is a byte-level BPE, B a sentencepiece model with byte fallback. Both read a space and the text. A text is cut where A's
pattern splits it and where no piece of B holds the two characters side by side: there both tokenizers always begin a new
token. So a *chunk* has the same tokens, groups and links wherever it stands; they are found once for each different chunk
and kept by the worker. (B reads a chunk behind a line feed, which is in none of its pieces, instead of its own first blank.)

* Groups lie between byte offsets where tokens of both end; links are the stretches between offsets where one of both ends.
* A link's ids are packed into one 64-bit key, A's id above B's. Each document's different keys, as sorted differences, and how
  often it has them are written to the folder in ``spark.checkpoint.dir``, so that no text is tokenised twice.
* In how many documents a key occurs is counted by ``np.unique`` in each partition of that table; the partial counts are
  range-partitioned by key, sorted, and equal keys summed as runs.
* The counts are written there as sorted shards of records of fixed width. The last pass maps the shards into memory, and
  looks up the keys of a batch by ``np.searchsorted``. Where that folder is no mounted one, Spark copies the shards to the
  executors (``SparkContext.addFile``).
* The highest count of each A id is a table with a row per id of A's vocabulary at most, which goes through the driver.

Memory of a task: the texts of a batch in pieces of 1 MB, the chunks kept (``KEPT`` of them or ``KEPT_BYTES``, then all are
forgotten), and ``PARTIAL`` partial counts. A longer text or chunk is worked on whole.

Null or empty texts, and texts whose tokens joined differ from a space and the text for A or B, have no tokens: counts of
zero and an empty ``groups_sha256``. Rows are aligned one by one, so repeated rows give equal results, each counted as a
document of its own. Null ids stay null. Empty tables give empty ones. Bytes that are no UTF-8 count as U+FFFD. Only the
columns named in ``keep`` pass through; columns of the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from . import words as W
from .common import files_in, folder_for, scratch, written

#: Chunks a worker keeps at most, and bytes of them.
KEPT, KEPT_BYTES = 300_000, 16 << 20
#: Partial counts a task holds before they are merged, and sent on if half as many are left.
PARTIAL = 1 << 20
#: A record of a shard: key and count as decimals of fixed width, and a line feed.
RECORD = np.dtype([("key", "S19"), ("n", "S19"), ("end", "S1")])
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, and their offsets (n+1)."""
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            described = json.load(f)
        back, special = byte_level(), {t["id"] for t in described["added_tokens"] if t["special"]}
        ranks = {bytes(back[c] for c in piece): k for piece, k in described["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for piece, k in ranks.items():
            by_id[k] = piece
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        shown = [x.replace("▁", " ") for k, x in enumerate(names) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        if any("\n" in x for x in shown) or len(self.b.encode("\n")) != 2:
            raise ValueError("a piece with a line feed: chunks could not be tokenised on their own")
        #: pairs of characters that stand side by side in a piece of B
        self.inside = np.unique([ord(x) << 21 | ord(y) for piece in shown for x, y in zip(piece, piece[1:], strict=False)]).astype(np.int64)
        own = [bytes([int(BYTE_PIECE.fullmatch(x)[1], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.a_bytes, self.a_at = _table(by_id)
        self.b_bytes, self.b_at = _table(own)
        self.bits = max(1, (len(names) - 1).bit_length())
        self.key_bits = self.bits + (len(by_id) - 1).bit_length()
        #: ids as decimals with the mark that follows: between ids, behind A's part of a group, behind a group
        self.marked = [b"%d%c" % (k, mark) for k in range(max(len(by_id), len(names))) for mark in b",|;"]


@lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def chunks_of(t: Tokenizers, data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The chunks of documents that begin with a space each, and each document's first chunk (n+1)."""
    raw = data.tobytes()
    point = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(point), bool)
    begins = np.searchsorted(lead, off[:-1])
    first[begins[begins < len(point)]] = True
    at = np.flatnonzero(bpe.token_starts(point, first))
    pair = np.where(first[at], -1, point[at - 1] << 21 | point[at])
    found = t.inside[np.minimum(np.searchsorted(t.inside, pair), len(t.inside) - 1)]
    at = np.append(lead[at[found != pair]], len(raw))
    bounds = at.tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], np.searchsorted(at[:-1], off)


def _says(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray, at: np.ndarray, chunks: list[bytes]) -> np.ndarray:
    """Whether the bytes of each chunk's ids are the chunk's."""
    width = at[ids + 1] - at[ids]
    ends = np.concatenate(([0], np.cumsum(width)))
    doc = np.concatenate(([0], np.cumsum(sizes)))
    joined, bounds = bpe.gather(table, at[ids], width).tobytes(), ends[doc].tolist()
    return np.fromiter((joined[x:y] == c for x, y, c in zip(bounds, bounds[1:], chunks, strict=False)), bool, len(chunks))


class Chunks:
    """What a worker knows of the chunks it has met: sizes, links, and the groups as text."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.held = 0
        self.ends = np.zeros(1, np.int64)  # of a chunk's keys in the pool
        self.pool = np.zeros(0, np.int64)
        self.facts = np.zeros((0, 5), np.int64)  # whether it can be aligned, tokens of A, of B, groups, links

    def slots(self, chunks: list[bytes]) -> np.ndarray:
        """The number of each chunk, after aligning those not met before."""
        if len(self.slot) > KEPT or self.held > KEPT_BYTES:
            self.forget()
        found = list(map(self.slot.get, chunks))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            self._align(list(dict.fromkeys([chunks[i] for i in new])))
            for i in new:
                found[i] = self.slot[chunks[i]]
        return np.array(found, np.int64)

    def _align(self, chunks: list[bytes]) -> None:
        t = self.t
        as_text = [c.decode() for c in chunks]
        a, b = list(map(t.a.encode_ordinary, as_text)), t.b.encode(["\n" + x for x in as_text], num_threads=1)
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip((a, b), sizes, strict=True)]
        lead = np.zeros(len(ids[1]), bool)  # B's first blank and the line feed
        lead[(np.cumsum(sizes[1]) - sizes[1])[:, None] + [0, 1]] = True
        ids[1], sizes[1] = ids[1][~lead], sizes[1] - 2
        good = _says(ids[0], sizes[0], t.a_bytes, t.a_at, chunks) & _says(ids[1], sizes[1], t.b_bytes, t.b_at, chunks)
        ids = [x[np.repeat(good, n)] for x, n in zip(ids, sizes, strict=True)]
        a_end = np.cumsum(t.a_at[ids[0] + 1] - t.a_at[ids[0]])
        b_end = np.cumsum(t.b_at[ids[1] + 1] - t.b_at[ids[1]])
        end = np.cumsum(np.where(good, [len(c) for c in chunks], 0))
        both, either = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
        key = ids[0][np.searchsorted(a_end, either)] << t.bits | ids[1][np.searchsorted(b_end, either)]
        # each chunk's groups and links end at or before its own end
        groups, links = (np.diff(np.concatenate(([0], np.searchsorted(x, end, "right")))) for x in (both, either))
        facts = np.column_stack([good, np.where(good, sizes[0], 0), np.where(good, sizes[1], 0), groups, links]).astype(np.int64)
        self.slot.update(zip(chunks, range(len(self.text), len(self.text) + len(chunks)), strict=True))
        self.text += self._as_text(ids, a_end, b_end, both, groups)
        self.held += sum(map(len, chunks))
        self.facts = np.concatenate((self.facts, facts))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(links)))
        self.pool = np.concatenate((self.pool, key))

    def _as_text(self, ids: list[np.ndarray], a_end: np.ndarray, b_end: np.ndarray, both: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """Each chunk's groups: A's ids before B's, each with the mark that follows it."""
        group = np.concatenate([np.searchsorted(both, x) for x in (a_end, b_end)])
        of_b = np.repeat([0, 1], [len(a_end), len(b_end)])
        order = np.argsort(group * 2 + of_b, kind="stable")
        group, of_b, flat = group[order], of_b[order], np.concatenate(ids)[order]
        last = np.ones(len(flat), bool)
        last[:-1] = (group[1:] != group[:-1]) | (of_b[1:] != of_b[:-1])
        names = list(map(self.t.marked.__getitem__, (flat * 3 + np.where(last, of_b + 1, 0)).tolist()))
        run = np.searchsorted(group, np.concatenate(([0], np.cumsum(groups)))).tolist()
        return [b"".join(names[x:y])[:-1] for x, y in zip(run, run[1:], strict=False)]

    def keys_by_document(self, slots: np.ndarray, doc: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different keys of each document that can be aligned, one document after the other, how often it has
        each, and each document's first (n+1)."""
        n = len(doc) - 1
        owner = np.repeat(np.arange(n), np.diff(doc))
        slots, owner = slots[good[owner]], owner[good[owner]]
        size = self.ends[slots + 1] - self.ends[slots]
        key, owner = bpe.gather(self.pool, self.ends[slots], size), np.repeat(owner, size)
        wide = self.t.key_bits
        if n << wide < 1 << 62:
            both, often = np.unique(owner << wide | key, return_counts=True)
            key, owner = both & (1 << wide) - 1, both >> wide
        else:
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))[: len(key)])
            often = np.diff(np.append(new, len(key)))
            key, owner = key[new], owner[new]
        return key, often, np.searchsorted(owner, np.arange(n + 1))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their runs."""
    if not len(key):
        return key, n
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def _by_document(facts: np.ndarray, slots: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each document can be aligned, and the sums of its chunks' facts (zeros where it can't)."""
    total = np.concatenate((np.zeros((1, facts.shape[1]), np.int64), np.cumsum(facts[slots], 0)))
    sums = total[doc[1:]] - total[doc[:-1]]
    good = (sums[:, 0] == np.diff(doc)) & (np.diff(doc) > 0)
    return good, np.where(good[:, None], sums, 0)


FACTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType())])
KEYS = T.StructType([T.StructField("__keys", T.ArrayType(T.LongType())), T.StructField("__often", T.ArrayType(T.IntegerType()))])
COUNTED = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])


def linked(df: DataFrame, a_path: str, b_path: str, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, facts of each row's alignment, its different keys as sorted differences and how often it has each."""
    schema = T.StructType([df.schema[c] for c in keep] + FACTS.fields + KEYS.fields)
    valid = F.make_valid_utf8(df[text])
    spaced = F.when(valid != "", F.concat(F.lit(" "), valid)).otherwise("").cast("binary").alias("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Chunks(tokenizers(a_path, b_path))
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(len(keep))):
                pieces, doc = chunks_of(known.t, data, off)
                slots = known.slots(pieces)
                good, facts = _by_document(known.facts, slots, doc)
                flat, bounds = list(map(known.text.__getitem__, slots.tolist())), doc.tolist()
                digest = [hashlib.sha256(b";".join(flat[x:y])).hexdigest() if g else "" for x, y, g in zip(bounds, bounds[1:], good.tolist(), strict=False)]
                key, often, at = known.keys_by_document(slots, doc, good)
                step = np.diff(key, prepend=0)
                begins = at[:-1][np.diff(at) > 0]
                step[begins] = key[begins]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), x) for x in (pa.array(step), pa.array(often.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[: len(keep)]], *[pa.array(facts[:, k]) for k in range(1, 5)], pa.array(digest, pa.string()), *lists], names=schema.fieldNames())

    return df.select(*keep, spaced).mapInArrow(run, schema)


def keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a batch of rows from their differences, and each row's first (n+1)."""
    at = column.offsets.to_numpy().astype(np.int64)
    step = column.flatten().to_numpy()
    at = at - at[0]
    total = np.concatenate(([0], np.cumsum(step)))
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at)), at


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n), sorted by key over all partitions: in how many rows of ``links`` a pair of ids occurs."""

    def sent(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=COUNTED.fieldNames())

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate(keys), np.concatenate(ns)
            order = np.argsort(key, kind="stable")
            return _summed(key[order], n[order])

        for batch in batches:
            key, n = np.unique(keys_of(batch.column(0))[0], return_counts=True)
            keys, ns, held = [*keys, key], [*ns, n.astype(np.int64)], held + len(key)
            if held > PARTIAL:
                key, n = merged()
                if len(key) > PARTIAL // 2:
                    yield sent(key, n)
                    key, n = key[:0], n[:0]
                keys, ns, held = [key], [n], len(key)
        yield sent(*merged())

    def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last key so far, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            key, n = _summed(np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((n, batch.column(1).to_numpy())))
            yield sent(key[:-1], n[:-1])
            key, n = key[-1:], n[-1:]
        yield sent(key, n)

    return links.select("__keys").mapInArrow(partial, COUNTED).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run_lengths, COUNTED)


def shards_of(counts: DataFrame) -> tuple[list[str], DataFrame]:
    """Write counts, sorted over all partitions, as records of fixed width: the files in order, as paths that tasks can
    open, and the table (key, n)."""
    spark = counts.sparkSession
    path = folder_for(spark)
    wide = [F.lpad(F.col(c).cast("string"), 19, "0") for c in ("key", "n")]
    counts.select(F.concat(*wide)).write.option("compression", "none").text(path)
    table = spark.read.schema("value string").text(path).select(F.substring("value", 1, 19).cast("long").alias("key"), F.substring("value", 20, 19).cast("long").alias("n"))
    files = [x for x in files_in(spark, path) if os.path.basename(x).startswith("part-")]
    if all(urlparse(x).scheme in ("", "file") for x in files):
        return [urlparse(x).path for x in files], table
    spark.sparkContext.addFile(path, recursive=True)
    return [f"{os.path.basename(path)}/{os.path.basename(x)}" for x in files], table


class Counts:
    """The shards, mapped into memory, and the highest count of each A id."""

    def __init__(self, shards: tuple[str, ...], best: np.ndarray, bits: int):
        paths = [x if os.path.isabs(x) else SparkFiles.get(x) for x in shards]
        self.shards = [np.memmap(x, RECORD, "r") for x in paths if os.path.getsize(x)]
        self.first = np.array([s["key"][0] for s in self.shards], "S19")
        self.best, self.bits = best, bits

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key, and whether it is the highest of its A id."""
        each, back = np.unique(key, return_inverse=True)
        name = np.char.zfill(each.astype("S19"), 19)
        shard = np.searchsorted(self.first, name, "right") - 1
        n = np.zeros(len(each), np.int64)
        for s in np.unique(shard).tolist():
            of = np.flatnonzero(shard == s)
            found = self.shards[s][np.searchsorted(self.shards[s]["key"], name[of])]
            n[of] = found["n"].astype(np.int64)
        return n[back], (n == self.best[each >> self.bits])[back]


@lru_cache(1)
def _lookup(shards: tuple[str, ...], best: bytes, bits: int) -> Counts:
    return Counts(shards, np.frombuffer(best, np.int64), bits)


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text), n_a and n_b (tokens), n_groups, n_links, n_best (links of the highest
    count of their A id), count_sum (over the links) and groups_sha256. Written to the shared folder."""
    names = [*FACTS.fieldNames(), "n_best", "count_sum"]
    keep = [c for c in df.columns if c not in (text, *names, *KEYS.fieldNames())] if keep is None else keep
    t = tokenizers(a_path, b_path)
    bits, best = t.bits, np.zeros(len(t.a_at), np.int64)
    with scratch(df.sparkSession) as kept:
        links = written(linked(df, a_path, b_path, text, keep))
        shards, counts = shards_of(pair_counts(links))
        for a, n in counts.groupBy(F.shiftright("key", bits).alias("a")).agg(F.max("n")).collect():  # a row per id of A at most
            best[a] = n
        shards, best = tuple(shards), best.tobytes()
        schema = T.StructType([*links.schema.fields[:-2], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        width = len(keep) + len(FACTS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, at = keys_of(batch.column(width))
                often = batch.column(width + 1).flatten().to_numpy().astype(np.int64)
                n, highest = _lookup(shards, best, bits).of(key)
                total = [np.concatenate(([0], np.cumsum(x))) for x in (often * highest, often * n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *[pa.array(x[at[1:]] - x[at[:-1]]) for x in total]], names=schema.fieldNames())

        return kept(links.mapInArrow(run, schema))


def public_paths() -> tuple[str, str]:
    """The default tokenizers: public ones, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, *public_paths())
