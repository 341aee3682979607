"""Language identification with a blended-spectrum string kernel.

Two texts are as similar as the n-grams (1 to 3 bytes of lower-cased text, runs of anything but
letters made one blank) that both hold, whatever their counts: the presence kernel, normalised by
the sizes of the two sets. A bounded sample of labelled texts gives Nystroem landmarks, the same number for each
language. With Z the landmarks' presence matrix, the features of a text x are K(x, Z) K(Z, Z)^(-1/2);
one-versus-rest kernel ridge regression is then a linear system of the landmarks' size, summed by
partition over all labelled rows. Since the features are linear in x's presence vector, scoring a batch is
one product of its presence matrix and the matrix Z' K(Z, Z)^(-1/2) B.

Learning uses all labelled rows. Each language weighs as its rows, but at most as its quota, an equal share
of ``TRAIN_ROWS``: so a rare language is not lost in a large table, where the ridge penalty would grow with
the others' rows. There are ``LANDMARKS`` landmarks a language (``MOST_LANDMARKS`` in all, but 2 a language at least); every text is scored whole. Only n-grams that some landmark
holds matter. ``und`` is predicted, with score 0, for null texts and those without a letter. If nothing
is labelled, all is ``und``. A text that occurs in many rows is one landmark, so repeated, null or equal ids don't matter. Empty tables give empty tables; repeated rows get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import fold

TRAIN_ROWS, LANDMARKS, MOST_LANDMARKS, RIDGE = 20_000, 64, 512, 1e-2
UNKNOWN = "und"

#: ASCII bytes that are not letters all become a blank; others stay.
_LETTER = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """Lower case, with one blank for each run of ASCII characters that are no letters."""
    s = text.decode("utf-8", "replace").lower().encode().translate(_LETTER)
    return b" " + b" ".join(s.split()) + b" "


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def grams(text: bytes) -> np.ndarray:
    """Codes of the distinct 1-, 2- and 3-grams of a normalised text."""
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (two[:-1] << np.uint32(8)) | x[2:]
    return np.unique(np.concatenate((x, two + np.uint32(1 << 8), three + np.uint32(1 << 24))))


class Space:
    """Places of the landmarks' n-grams in the presence vectors."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.size = len(codes)

    @property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _tables(self.codes.tobytes())

    def presence(self, texts: list[bytes]) -> np.ndarray:
        """0/1 rows, each divided by the root of its sum."""
        one, two, three = self.tables
        out = np.zeros((len(texts), self.size + 1), np.float32)
        for row, text in zip(out, texts, strict=True):
            for a in range(0, max(len(text) - 2, 1), 1 << 20):  # the two bytes after a piece belong to its n-grams
                x = np.frombuffer(text[a : a + (1 << 20) + 2], np.uint8).astype(np.uint32)
                pair = (x[:-1] << np.uint32(8)) | x[1:]
                row[one[x]] = 1
                row[two[pair]] = 1
                row[three[(pair[:-1] << np.uint32(8)) | x[2:]]] = 1
        out = out[:, : self.size]
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))


@lru_cache(2)
def _tables(codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each n the place of every possible n-gram; absent ones share a last place that is thrown away."""
    c = np.frombuffer(codes, np.uint32)
    place = np.arange(len(c), dtype=np.int32)
    out = []
    for low, size in ((0, 1 << 8), (1 << 8, 1 << 16), (1 << 24, 1 << 24)):
        table = np.full(size, len(c), np.int32)
        own = (c >= low) & (c < low + (size if size < 1 << 24 else 1 << 25))
        table[c[own] - low] = place[own]
        out.append(table)
    return tuple(out)


class Model:
    def __init__(self, space: Space, matrix: np.ndarray, bias: np.ndarray, langs: list[str]):
        self.space, self.matrix, self.bias, self.langs = space, matrix, bias, langs

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            f = self.space.presence([normal(texts[i]) for i in part]) @ self.matrix + self.bias
            best = f.argmax(1)
            soft = np.exp(4 * (f - f.max(1, keepdims=True)))
            for i, b, s in zip(part, best.tolist(), (1 / soft.sum(1)).tolist(), strict=True):
                names[i], scores[i] = self.langs[b], s
        return names, np.round(scores, 6)


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from rows (id, text, lang); null languages, null texts and texts without words are left out."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    per_lang = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not per_lang:
        return None
    langs = sorted(per_lang)
    landmarks = max(2, min(landmarks, MOST_LANDMARKS // len(langs)))
    quota = train_rows / len(langs)
    weights = np.array([min(1.0, quota / per_lang[k]) for k in langs])
    # landmarks are different texts: of each language those of the lowest hashes, however often they occur and whatever their ids
    named = labelled.withColumn("th", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(2), "th"), "th")
    best = named.select("lang", "th").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= landmarks)
    some = named.join(F.broadcast(best), ["lang", "th"]).dropDuplicates(["lang", "th"])

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(normal(t.as_py())).astype(np.int64) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["grams"])

    sets = [np.array(r.grams, np.uint32) for r in some.orderBy("lang", "k").select(F.col("text").cast("binary")).mapInArrow(gram_rows, "grams array<long>").collect()]
    codes = np.unique(np.concatenate(sets))
    z = np.zeros((len(sets), len(codes)), np.float32)
    for row, s in zip(z, sets, strict=True):
        row[np.searchsorted(codes, s)] = 1
    z /= np.sqrt(z.sum(1, keepdims=True))
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    good = value > 1e-6 * value.max()
    project = (z.T @ (vector[:, good] / np.sqrt(value[good]))).astype(np.float32)  # presence -> Nystroem features
    space, size = Space(codes.astype(np.uint32)), int(good.sum()) + 1
    code = {k: i for i, k in enumerate(langs)}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + len(langs)))
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                phi = np.column_stack([space.presence([normal(t.as_py()) for t in part.column(0)]) @ project, np.ones(len(part))])
                y = np.full((len(part), len(langs)), -1.0)
                own = [code[x] for x in part.column(1).to_pylist()]
                y[np.arange(len(part)), own] = 1
                total += (phi * weights[own, None]).T @ np.column_stack([phi, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + len(langs)))
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    train = labelled.select(F.col("text").cast("binary"), "lang")
    tree = train.mapInArrow(partial, "sums binary").repartition(8).mapInArrow(add, "sums binary")
    sums = sum(np.frombuffer(r.sums).reshape(size, -1) for r in tree.collect())
    penalty = ridge * max(sums[size - 1, size - 1], 1.0) / size * np.eye(size)
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(sums[:, :size] + penalty, sums[:, size:])
    return Model(space, (project @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32), langs)


def languages(df: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row of ``df``."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in W.chunks(batch.column(1)):
                raw, at = data.tobytes(), off.tolist()
                texts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
                names, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores)], names=schema.fieldNames())

    return df.select(df[id_col].alias("id"), df[text].cast("binary").alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.where(fold("doc_id") != 2).select(F.col("doc_id").alias("id"), "text", "lang")
    out = languages(docs.select("doc_id", "text"), fit(labelled))
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 2).alias("held_out"), "lang_pred", "score")
