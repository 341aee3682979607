"""Byte-level BPE encoding and decoding without a regex.

Texts are turned into an array of code-point classes (letter, number, white space, other).
A token of the public split pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
starts where the class changes, with two corrections: one blank before a run belongs to the
run, and a lone apostrophe may open a contraction. Both look at the start of the current run,
which is a scan of the transition functions "restart here" and "carry on"; their composition is
the maximum of positions, so the scan is ``np.maximum.accumulate``. The resulting byte slices
feed a pair merge whose results are cached per worker in a pool of ids; the pool offsets are
kept, and decoding gathers the bytes of the ids by the vocabulary's offsets.

Null text counts as empty: no tokens, and the hash of no bytes. Special tokens are never
produced. Bytes of a text that are no UTF-8 count as U+FFFD, as they do when Python reads them. A very long piece is
merged with a heap, in n log n. Other columns pass through, but for those of the names of results; rows are
encoded one by one, so repeated rows give equal results, and empty tables empty ones.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: At most so many distinct pieces are remembered by a worker; then it forgets all and starts anew.
CACHE_PIECES = 400_000

#: Pieces of more bytes than this are merged one by one, with a heap.
LONG = 64
NONE = 1 << 30
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        out[c] = kind.get(unicodedata.category(chr(c))[0], OTHER)
    out[WHITE_SPACE] = SPACE
    return out


def token_starts(point: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``first`` marks where a document begins."""
    n = len(point)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[point]
    index = np.arange(n)
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = (kind[1:] != kind[:-1]) | first[1:]
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (point[:-1] == 0x20) & ~first[1:]
    # a run of white space starts a token; its last character starts another unless the document ends there
    ends = np.ones(n, bool)
    ends[:-1] = run[1:]
    document_ends = np.ones(n, bool)
    document_ends[:-1] = first[1:]
    start = np.where(space, run | (ends & ~document_ends), run & ~blank_before)
    # contractions: a lone apostrophe that starts a token, before s t m d or re ve ll
    opening = np.maximum.accumulate(np.where(run, index, 0))  # start of the current run
    lone = (point == 0x27) & (opening == index) & ends & start & ~document_ends
    at = np.flatnonzero(lone)
    if len(at):
        one = point[at + 1]
        two = np.where(at + 2 < n, point[np.minimum(at + 2, n - 1)], 0)
        two[(at + 2 < n) & first[np.minimum(at + 2, n - 1)]] = 0
        is_two = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))
        is_one = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        size = np.where(is_one, 2, np.where(is_two, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + size
        after = after[after < n]
        start[after[kind[after] != SPACE]] = True  # a run of white space has its own starts already
    return start


class Vocabulary:
    """Ranks of byte strings, offsets of their bytes for decoding, and the pieces merged so far."""

    def __init__(self, path: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        size = max(self.rank.values()) + 1
        by_id = [b""] * size
        for piece, k in self.rank.items():
            by_id[k] = piece
        self.offset = np.concatenate(([0], np.cumsum([len(x) for x in by_id])))
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.decimal = [str(k) for k in range(size)]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self._index_pairs()
        self.forget()

    def _index_pairs(self) -> None:
        """An open-addressing table from a pair of ids to the id of their concatenation."""
        rank = self.rank
        keys, ids = [], []
        for piece, k in rank.items():
            for i in range(1, len(piece)):
                if (a := rank.get(piece[:i])) is not None and (b := rank.get(piece[i:])) is not None:
                    keys.append(a << 32 | b)
                    ids.append(k)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int64)
        todo, value = np.array(keys, np.int64), np.array(ids, np.int64)
        at = self._place(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = todo[free]  # of several for one place the last stays
            won = self.keys[at] == todo
            self.ids[at[won]] = value[won]
            todo, value, at = todo[~won], value[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id, which is the rank, of each pair's concatenation, or NONE."""
        key = left << 32 | right
        at = self._place(key)
        out = np.where(self.keys[at] == key, self.ids[at], NONE)
        rest = np.flatnonzero((out == NONE) & (self.keys[at] >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.ids[at[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.used = 0  # slots; slot k is pool[ends[k] : ends[k + 1]]

    def remember(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        base, at = self.used, int(self.ends[self.used])
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while base + len(pieces) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.pool[at : at + len(ids)] = ids
        self.ends[base + 1 : base + 1 + len(pieces)] = at + np.cumsum(sizes)
        self.slot.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.used += len(pieces)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of distinct pieces.

        In each round every piece merges its adjacent pair of lowest rank, the leftmost if several
        have it; pieces that have no pair left drop out.
        """
        result: list = [None] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                result[k] = [r]
            elif len(p) > LONG:
                result[k] = self._merge_long(p)
            else:
                short.append(k)
        if short:
            size = np.array([len(pieces[k]) for k in short])
            own = np.array(short)
            part = self.single[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
            pair = None
            while len(own):
                first = np.cumsum(size) - size
                last = first + size - 1
                if pair is None:
                    pair = np.full(len(part), NONE, np.int64)
                    pair[:-1] = self.merged(part[:-1], part[1:])
                    pair[last] = NONE
                best = np.minimum.reduceat(pair << 32 | np.arange(len(part)), first)
                done = best >> 32 == NONE
                if done.any():
                    for k, a, n in zip(own[done].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                        result[k] = part[a : a + n]
                    stay = np.repeat(~done, size)
                    part, pair = part[stay], pair[stay]
                    own, size, best = own[~done], size[~done], best[~done]
                    if not len(own):
                        break
                    at = (np.cumsum(stay) - 1)[best & 0xFFFFFFFF]
                else:
                    at = best & 0xFFFFFFFF
                part[at] = best >> 32
                keep = np.ones(len(part), bool)
                keep[at + 1] = False
                part, pair = part[keep], pair[keep]
                at = at - np.arange(len(at))  # one part before each has gone from every earlier piece
                size = size - 1
                first = np.cumsum(size) - size
                last = first + size - 1
                right = at < last
                pair[at] = NONE
                pair[at[right]] = self.merged(part[at[right]], part[at[right] + 1])
                left = at > first
                pair[at[left] - 1] = self.merged(part[at[left] - 1], part[at[left]])
        sizes = np.fromiter(map(len, result), np.int64, len(result))
        return np.concatenate(result) if result else np.zeros(0, np.int64), sizes

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece, by a heap."""
        n, rank = len(piece), self.rank
        end = list(range(1, n + 1))  # end of the part that starts at i; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := rank.get(piece[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def slots(self, pieces: list[bytes]) -> np.ndarray:
        """For each piece its place in the pool, after merging those not met before."""
        found = list(map(self.slot.get, pieces))
        new = list(dict.fromkeys([p for p, k in zip(pieces, found, strict=True) if k is None]))
        if new:
            self.remember(new, *self.merge(new))
            found = list(map(self.slot.__getitem__, pieces))
        return np.array(found, np.int64)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of data[start : start + size] over all slices."""
    first = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces_of(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Slices of a chunk, their byte offsets (with the end), and each document's first slice (n+1)."""
    raw = data.tobytes()
    point = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(len(point), bool)
    begins = np.searchsorted(lead, off[:-1])
    first[begins[begins < len(point)]] = True
    at = np.append(lead[token_starts(point, first)], len(raw))
    bounds = at.tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], at, np.searchsorted(at[:-1], off)


def encode_chunk(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk, and each document's first id (n+1)."""
    pieces, _, doc = pieces_of(data, off)
    if v.used > CACHE_PIECES:
        v.forget()
    k = v.slots(pieces)
    size = v.ends[k + 1] - v.ends[k]
    ids = gather(v.pool, v.ends[k], size).astype(np.int64) if len(k) else np.zeros(0, np.int64)
    return ids, np.concatenate(([0], np.cumsum(size)))[doc]


def decode_chunk(v: Vocabulary, ids: np.ndarray, doc: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of ids, and where each document's begin (n+1)."""
    size = v.offset[ids + 1] - v.offset[ids]
    at = np.concatenate(([0], np.cumsum(size)))
    return gather(v.bytes, v.offset[ids], size).tobytes(), at[doc]


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``ids``, the token ids of the whole text, and
    ``starts``, the byte offset at which each of the text's pieces begins."""
    keep = [c for c in df.columns if c not in (text, "ids", "starts")] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(len(keep))):
                ids, doc = encode_chunk(v, data, off)
                _, at, piece = pieces_of(data, off)
                local = at[:-1] - np.repeat(off[:-1], np.diff(piece))
                part = batch.slice(i, j - i)
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x.astype(np.int32))) for o, x in ((doc, ids), (piece, local))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *lists], schema=pa.schema([*[batch.schema.field(c) for c in range(len(keep))], *[pa.field(c, pa.list_(pa.int32())) for c in ("ids", "starts")]]))

    return df.select(*keep, F.make_valid_utf8(df[text]).cast("binary").alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with column ``out``: the text of the token ids (null ids: empty)."""
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        at = keep.index(ids)
        for batch in batches:
            texts = [decode_chunk(v, np.array(x or [], np.int64), np.zeros(1, np.int64))[0].decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digest(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text), the number of tokens, and SHA-256 of the ids as decimal text and of the decoded bytes.

    Ids are encoded and decoded in the same task and never leave it.
    """
    names = DIGEST.fieldNames()
    keep = [c for c in df.columns if c not in (text, *names)] if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + DIGEST.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sha = hashlib.sha256
        for batch in batches:
            count, one, two = [], [], []
            for _, _, data, off in W.chunks(batch.column(len(keep))):
                ids, doc = encode_chunk(v, data, off)
                back, at = decode_chunk(v, ids, doc)
                count.append(np.diff(doc))
                names_of, bounds, flat = v.decimal, doc.tolist(), ids.tolist()
                one += [sha(" ".join([names_of[x] for x in flat[a:b]]).encode()).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]
                two += [sha(back[a:b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            total = np.concatenate(count) if count else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=[*keep, *names])

    return df.select(*keep, F.make_valid_utf8(df[text]).cast("binary").alias("__text")).mapInArrow(run, schema)


def public_path() -> str:
    """The default vocabulary: a public one of 50k ranks, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, public_path())
