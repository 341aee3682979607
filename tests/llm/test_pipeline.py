"""The pipeline: each stage on its predecessor's rows, against brute-force versions."""

import base64
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from candela.llm import common
from candela.llm.common import written

from . import edge
from .test_text_ops import brute_classes, brute_counts, brute_lines, brute_targets


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], f"{data}/sf0.001")))
    assert all(s.columns == columns for s in steps[:-1])
    start, rules, lines, near, mix, last = ([r.asDict() for r in s.collect()] for s in steps)

    kept = {r["doc_id"] for r in rules}
    for r in start:
        n, chars, symbols, dup, repeat = brute_counts(r["text"])
        if n < 50 or 2 * repeat > n:
            assert r["doc_id"] not in kept
        elif 10 * symbols <= 3 * n and 2 * dup <= len(r["text"].split("\n")) and sum(c.isupper() for c in r["text"]) < 0.2 * chars:
            assert r["doc_id"] in kept, "clean documents stay"

    cut = brute_lines([(r["doc_id"], r["text"]) for r in rules], 1)
    left = {r["doc_id"]: r for r in lines}
    assert set(left) == {i for i, (n, gone) in cut.items() if gone < n}
    assert all(len([x for x in left[i]["text"].split("\n") if x.strip()]) == cut[i][0] - cut[i][1] for i in left)

    classes = brute_classes([(r["doc_id"], r["text"]) for r in lines], 5, 80)
    assert {r["doc_id"] for r in near} == {i for i, (_, root) in classes.items() if i == root}

    size = {r["doc_id"]: len(r["text"].split()) for r in near}
    per, source = Counter(), {r["doc_id"]: r["source"] for r in near}
    for i, n in size.items():
        per[source[i]] += n
    target, taken, times = brute_targets(per), Counter(), Counter(r["doc_id"] for r in mix)
    assert max(times.values()) <= 2 and set(times) <= set(size)
    for i, k in times.items():
        taken[source[i]] += k * size[i]
    for s in per:
        assert abs(taken[s] - target[s]) <= 0.5 * max(size[i] for i in size if source[i] == s) + 1

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = {}
    for r in mix:
        ids = enc.encode_ordinary(r["text"])
        digest[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    assert Counter(r["doc_id"] for r in last) == times
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digest[r["doc_id"]] for r in last)


def test_run_is_the_stages_in_order(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "byte-level BPE"]
    assert corpus_pipeline.run(spark, f"{data}/sf0.001").count() > 0


def test_stages_on_awkward_and_empty_tables(spark):
    """Every stage takes the awkward rows and clashing columns that its predecessor kept, and an empty table."""
    for start in (edge.documents(spark), edge.empty(spark)):
        steps = [start]
        for _, stage in corpus_pipeline.STAGES:
            steps.append(written(stage(spark, steps[-1], "")))
        assert all(s.columns == start.columns for s in steps[:-1]) and [f.dataType for f in steps[-2].schema] == [f.dataType for f in start.schema]
        counts = [s.count() for s in steps]
        if counts[0]:
            ids = [{r.doc_id for r in s.collect()} for s in steps]
            assert {1, 2, 3, 4, 5} & ids[1] == set() and {6, 8, None} <= ids[1] and ids[-1] <= ids[3] <= ids[2] <= ids[1] and counts[-1] == counts[-2] > 0
            # 7 repeats 6 and goes with its lines; the two rows of 8 are one document and both stay
            assert 7 not in ids[2] and [r.doc_id for r in steps[3].collect()].count(8) == 2
        else:
            assert counts == [0] * 6


def test_run_leaves_no_tables_but_its_own(spark, data, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, f"{data}/sf0.001")
    (folder,) = os.listdir(tmp_path)
    assert out.count() > 0 and len(os.listdir(tmp_path / folder)) <= 3


def test_shared_folder_of_a_local_and_of_a_cluster_session():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        applicationId, master = "app", "local[2]"

    class Session:
        conf, sparkContext = Conf(), Context()

    assert common.shared_dir(Session()) == common.shared_dir(Session()) != ""
    Context.master = "spark://somewhere:7077"
    with pytest.raises(RuntimeError, match="share"):
        common.shared_dir(Session())
