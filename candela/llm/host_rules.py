"""Quality rules by host.

Each document's whole text gives counts; a few rules judge them. Rule failures are summed by
host, each host's failure rate is shrunk towards an empirical beta prior fitted over all
hosts, and the verdict of the host is joined back to its documents:

* a *blocked* host (some shrunken rate >= ``block``) loses all its documents;
* on a host *watched* for a rule (shrunken rate >= ``watch``) a document that fails this rule goes;
* elsewhere only the base rules count.

The base rules apply everywhere: fewer than 50 words, or more than half of the words in
3-word windows that the text holds twice or more.

Null and empty texts have zero counts and fail the base rules. A null host is a host of its
own. Repeated rows are judged each like the first. An empty table gives an empty table.
Columns other than id, text and host are ignored by the counts and kept if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import same, sized, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]
RULES = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "2 * n_dup_lines > n_lines",
    "capitals": "n_upper > n_lower",
}
WATCH, BLOCK = 0.02, 0.8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
#: Bytes that begin a code point and are not white space.
_HEAD = np.array([(b & 0xC0) != 0x80 and not W.IS_SPACE[b] for b in range(256)])


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def _repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in the same document."""
    n = len(first) - 1
    if len(h) < 3:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    at = np.flatnonzero(doc[:-2] == doc[2:])
    key = W.mix(W.window_hashes(h, 3)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    equal = s[1:] == s[:-1]
    twice = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
    hit = at[order[twice]]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[hit + k] = True
    return _per_doc(covered, first)


def count_chunk(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The counts of :data:`COUNTS` for each document of a chunk."""
    starts, ends, first = W.word_spans(data, off)
    raw = data.tobytes()
    lines, dup = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    bounds = off.tolist()
    for i in range(len(bounds) - 1):
        own = [x for x in raw[bounds[i] : bounds[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(own)
        dup[i] = len(own) - len(set(own))
    return [
        np.diff(first),
        _per_doc(_HEAD[data], off),
        _per_doc(_SYMBOL[data], off),
        dup,
        _repeat_words(W.word_hashes(data, starts, ends), first),
        lines,
        _per_doc(_UPPER[data], off),
        _per_doc(_LOWER[data], off),
    ]


def rule_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (default: all) and the counts of each whole text.

    A column of ``df`` that has the name of a count is replaced by the count.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in COUNTS]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    source = df.select(*keep, df[text].cast("binary").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_chunk(data, off) for _, _, data, off in W.chunks(batch.column(len(keep)))]
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, cols)], names=[*keep, *COUNTS])

    return source.mapInArrow(count, schema)


def base_failed():
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def host_verdicts(counts: DataFrame, host: str = "source", watch: float = WATCH, block: float = BLOCK) -> DataFrame:
    """One row per host: its documents, for each rule the shrunken failure rate, and the verdicts.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates,
    less the variance that binomial sampling alone would give; it comes from sums over hosts,
    so nothing but one row per host leaves the first aggregate.
    """
    per_host = written(counts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"CASE WHEN {rule} THEN 1 ELSE 0 END")).alias(f"f_{k}") for k, rule in RULES.items()]))
    prior = per_host.agg(
        *[F.avg(F.col(f"f_{k}") / F.col("n")).alias(f"m_{k}") for k in RULES],
        *[F.var_pop(F.col(f"f_{k}") / F.col("n")).alias(f"v_{k}") for k in RULES],
        F.avg(1 / F.col("n")).alias("inv_n"),
    ).first()
    out = per_host
    for k in RULES:
        m, v = prior[f"m_{k}"] or 0.0, prior[f"v_{k}"] or 0.0
        strength = min(max(m * (1 - m) / max(v - m * (1 - m) * (prior["inv_n"] or 0.0), 1e-9) - 1, 1.0), 1e6)
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + m * strength) / (F.col("n") + strength))
    return out.select(
        "host",
        "n",
        *[f"rate_{k}" for k in RULES],
        *[(F.col(f"rate_{k}") >= watch).alias(f"watch_{k}") for k in RULES],
        F.expr(" OR ".join(f"rate_{k} >= {block}D" for k in RULES)).alias("blocked"),
    )


def judge(counts: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """``counts`` with base_failed and kept, by the verdicts of their hosts."""
    verdicts = written(verdicts.select("host", *[f"watch_{k}" for k in RULES], "blocked"))
    n = verdicts.count()
    named = verdicts.select([F.col(c).alias(f"__{c}") for c in verdicts.columns])
    joined = counts.join(sized(named, n), counts[host].eqNullSafe(F.col("__host")), "left")
    fails = " OR ".join(f"(__watch_{k} AND {rule})" for k, rule in RULES.items())
    return joined.select(*counts.columns, base_failed().alias("base_failed"), (~base_failed() & ~F.expr(f"__blocked OR {fails}")).alias("kept"))


def host_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, the counts, base_failed and kept. Counts are made once and kept in scratch."""
    counts = written(rule_counts(df, text, keep=list(dict.fromkeys([id_col, host]))))
    return judge(counts, host_verdicts(counts, host), host)


def keep_good(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that the rules keep, with all its columns.

    Texts are read twice (for the hosts, then for the rows) rather than shuffled.
    """
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), df[text].alias("__t"), df[host].alias("__h"))
    verdicts = host_verdicts(rule_counts(rows, "__t", keep=["__h"]), "__h")
    return judge(rule_counts(rows, "__t", keep=["__row", "__h"]), verdicts, "__h").where("kept").select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, [ws[i], ws[i+1], ws[i+2]] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY COUNT(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(COALESCE(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        10 * n_symbols > 3 * n_words AS r1, 2 * n_dup_lines > n_lines AS r2, n_upper > n_lower AS r3 FROM c),
h AS (SELECT source, COUNT(*) AS n, unnest([1, 2, 3]) AS r,
        unnest([SUM(CAST(r1 AS INT)), SUM(CAST(r2 AS INT)), SUM(CAST(r3 AS INT))])::DOUBLE AS bad FROM f GROUP BY source),
p AS (SELECT r, AVG(bad / n) AS m, VAR_POP(bad / n) AS v, AVG(1.0::DOUBLE / n) AS inv FROM h GROUP BY r),
s AS (SELECT r, m, LEAST(GREATEST(m * (1 - m) / GREATEST(v - m * (1 - m) * inv, 1e-9::DOUBLE) - 1, 1.0::DOUBLE), 1e6::DOUBLE) AS k FROM p),
rate AS (SELECT source, h.r, (bad + m * k) / (n + k) AS rate FROM h JOIN s ON h.r = s.r),
v AS (SELECT source, BOOL_OR(rate >= 0.8::DOUBLE) AS blocked, BOOL_OR(r = 1 AND rate >= 0.02::DOUBLE) AS w1,
        BOOL_OR(r = 2 AND rate >= 0.02::DOUBLE) AS w2, BOOL_OR(r = 3 AND rate >= 0.02::DOUBLE) AS w3 FROM rate GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (blocked OR (w1 AND r1) OR (w2 AND r2) OR (w3 AND r3)) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
