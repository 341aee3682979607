"""Benchmark windows, periodic runs and the alignment of tokenizers against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candela.llm import align, periodic, winnow, words

from . import edge

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_windows(docs, items):
    found = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        m = min(10, len(w))
        for a in range(len(w) - m + 1) if m else []:
            found[m, tuple(w[a : a + m])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, met = set(), set()
        for m in {m for m, _ in found}:
            for a in range(len(w) - m + 1):
                if own := found.get((m, tuple(w[a : a + m]))):
                    hit |= set(range(a, a + m))
                    met |= own
        out.append((i, len(w), len(hit), len(met), ",".join(sorted(met))))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("shortest", [0, 10])
@pytest.mark.parametrize("few", [True, False])
def test_windows_match_brute_force(spark, monkeypatch, shortest, few):
    """Items of any length, null and repeated ids, repeated rows; the join by broadcast and by shuffle."""
    monkeypatch.setattr("candela.llm.common.BROADCAST_ROWS", 20_000 if few else 0)
    rng = random.Random(4 + shortest)
    text = lambda n: "".join(rng.choice(["a", "B", "c", "É", "7"]) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    items = [(i, text(rng.randint(shortest, 25))) for i in range(40)] + [(3, text(12)), (None, text(11)), (None, None), (50, "")]
    docs = [(i, text(rng.randint(0, 80)) + (rng.choice(items)[1] or "") + text(5)) for i in range(100)] + [(None, None), (7, ""), (7, items[5][1]), (7, items[5][1])]
    got = winnow.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ordered(got.collect()) == ordered(brute_windows(docs, items))


def test_winnowing_misses_no_window_and_is_sparse():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 5000).astype(np.uint64)
    first = np.array([0, 3, 3, 1000, 5000])
    for length in (1, 3, 5, 7, 10):
        start, print_, place = winnow.fingerprints(h, first, length)
        assert len(start) == sum(max(0, n - length + 1) for n in np.diff(first).tolist())
        assert ((place >= start) & (place <= start + length - min(5, length))).all()
        for other in range(4):  # the same words elsewhere have the same fingerprint, at the same place
            s2, p2, a2 = winnow.fingerprints(np.concatenate((h[:other], h)), np.concatenate(([0, other], first[1:] + other)), length)
            own = np.isin(s2 - other, start)
            assert (p2[own] == print_).all() and (a2[own] - s2[own] == place - start).all()
    assert len(set(winnow.fingerprints(h, first, 10)[2].tolist())) < 0.45 * len(h)


def test_windows_edges(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")
    by = {r.id: r for r in winnow.contaminated(edge.documents(spark), items).collect()}
    assert by[5].n_hit == 3 and by[5].items == "1" and by[4].n_hit == 0 and by[1].n_words == 0 and by[9].n_words == 60_001
    assert winnow.contaminated(edge.documents(spark), items).count() == len(edge.ROWS)
    assert winnow.contaminated(edge.empty(spark), items).count() == 0
    none = winnow.contaminated(edge.documents(spark), items.limit(0)).collect()
    assert len(none) == len(edge.ROWS) and {(r.n_hit, r.n_items, r["items"]) for r in none} == {(0, 0, "")}


def test_many_documents_share_one_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.col("id").cast("string")).alias("text"))
    items = spark.range(500).select(F.col("id").alias("item_id"), F.lit("x y " + passage).alias("text"))
    out = winnow.contaminated(docs, items).agg(F.count("*"), F.min("n_hit"), F.max("n_hit"), F.min("n_items"), F.count_distinct("items")).first()
    assert tuple(out) == (3000, 30, 30, 500, 1)


def brute_runs(w, least=6, times=4):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.6:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            out += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
        else:
            out += [rng.choice(["a", "b", "c", "dd", "ee"]) for _ in range(rng.randint(0, 30))]
    return out


@pytest.mark.parametrize("least,times", [(6, 4), (8, 4), (5, 5)])
def test_runs_match_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = [" ".join(random_words(rng)) for _ in range(rng.randint(1, 6))]
        for i, j, data, off in words.chunks(pa.array([t.encode() for t in texts], pa.binary())):
            starts, ends, doc = words.word_spans(data, off)
            rows = periodic.runs_in(data, starts, ends, doc, least, times).tolist()
            for k in range(j - i):
                assert [(a - int(doc[k]), n, q) for a, n, q in rows if doc[k] <= a < doc[k + 1]] == brute_runs(texts[k].split(), least, times)


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    text = "a b a b a b a b x y " + "c d " * 5
    monkeypatch.setattr(words, "word_hashes", lambda data, starts, ends: np.ones(len(starts), np.uint64))
    for _, _, data, off in words.chunks(pa.array([text.encode()], pa.binary())):
        assert periodic.runs_in(data, *words.word_spans(data, off)).tolist() == [[0, 8, 2], [10, 10, 2]]


def test_runs_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(random_words(rng)) + rng.choice(["", "\n", " \t"])) for i in range(400)] + [(None, "a " * 9), (1000, None), (1001, ""), (1002, " \n"), (7, "z " * 40), (7, "z " * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def expected(i, t):
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        return (i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))

    got = periodic.query(spark, str(tmp_path)).collect()
    assert ordered(got) == ordered(expected(*d) for d in docs)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20


def test_runs_edges(spark):
    by = {r.doc_id: r for r in periodic.periodic_runs(edge.documents(spark)).collect()}
    assert by[1].runs == [] and by[1].collapsed == "" and by[1].n_words == 0 and by[9].n_words == 60_001
    assert [tuple(r) for r in by[12].runs] == [(0, 330, 11)] and by[12].collapsed == "same line of ten words which is here for a test"
    assert periodic.periodic_runs(edge.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(edge.empty(spark), times=3)


def brute_alignment(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = align.byte_level()
    a_bytes = lambda k: bytes(back[c] for c in t.id_to_token(k))
    b_bytes = lambda k: bytes([int(s.id_to_piece(k)[3:5], 16)]) if s.is_byte(k) else s.id_to_piece(k).replace("▁", " ").encode()
    docs, often = [], Counter()
    for x in texts:
        a, b = (t.encode(" " + x, add_special_tokens=False).ids, s.encode(x)) if x else ([], [])
        whole = (" " + (x or "")).encode()
        if not x or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append(None)
            continue
        a_end, b_end = (np.cumsum([len(f(k)) for k in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b)))
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            p, q = a_end[i], b_end[j]
            i, j = i + (p <= q), j + (q <= p)
        groups, i, j = [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            i2, j2 = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        docs.append((len(a), len(b), groups, links))
        often.update(set(links))
    best = Counter()
    for (a, _), n in often.items():
        best[a] = max(best[a], n)
    return [
        (0,) * 6 + ("",) if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(often[x] == best[x[0]] for x in d[3]), sum(often[x] for x in d[3]), sha(";".join(d[2])))
        for d in docs
    ]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_both_libraries(spark, data, monkeypatch):
    """Real texts, and random ones with white space, joiners, other scripts, compatibility characters and special tokens' names."""
    monkeypatch.setattr(align, "PARTIAL", 5_000)
    rng = random.Random(3)
    some = ["a", "b", "the", " ", " ", "  ", "\n", "\t", "'s", "'ll", " '", "é", "漢", "😀", " ", " ", "▁", "ﬁ", "Ａ", "é", "<s>", "<|endoftext|>", "<0x41>", "<unk>", "1", "23", "!", "..", "\r\n", "\x00", "\x0b", "​", "﻿", "\x85", "ß"]
    texts = [None, "", " ", "  ", "x" * 20_000, "ab " * 9000, "same", "same"] + ["".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in ALIGNED) for r in align.align(df, *align.public_paths()).collect()}
    want = brute_alignment(texts)
    assert got == dict(enumerate(want)) and sum(w[0] == 0 for w in want) > 100 and sum(w[0] > 0 for w in want) > 500


def test_alignment_edges_and_shards_by_spark(spark, monkeypatch):
    docs = edge.documents(spark).withColumn("n_best", F.lit("x")).withColumn("__keys", F.lit(1))
    plain = align.align(docs, *align.public_paths())
    assert plain.count() == len(edge.ROWS) and plain.select("doc_id", *ALIGNED).where("doc_id = 8").distinct().count() == 1
    assert align.align(edge.empty(spark), *align.public_paths()).count() == 0
    # a shared folder that tasks can't open: Spark brings the shards
    monkeypatch.setattr(align, "urlparse", lambda x: type("Url", (), {"scheme": "other"}))
    brought = align.align(docs, *align.public_paths())
    assert brought.select("doc_id", *ALIGNED).exceptAll(plain.select("doc_id", *ALIGNED)).count() == 0
