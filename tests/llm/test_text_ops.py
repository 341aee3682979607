"""Counts, near duplicates, lines and mixing against brute-force versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import components, host_rules, line_dedup, mixing, near_dup, words

from . import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    cover = {i + k for i, g in enumerate(windows) if often[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(5)
    texts = [r[1] for r in edge.ROWS] + ["".join(rng.choice("ab \n\t#é\x0b\x85") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in host_rules.rule_counts(df, keep=["doc_id"]).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_host_rules_edges_and_verdicts(spark):
    out = host_rules.host_rules(edge.documents(spark)).collect()
    assert len(out) == len(edge.ROWS)
    by = {r.doc_id: r for r in out}
    assert by[1].base_failed and not by[1].kept and by[12].base_failed and by[6].kept
    assert host_rules.host_rules(edge.empty(spark)).count() == 0
    good, bad = edge.PLAIN.format(i=1), "BAD $$$ TEXT ### HERE *** NOW %%% " * 20
    text = [(i, good + str(i), "clean") for i in range(40)] + [(100 + i, " ".join(f"W{i}{k}$$$$" for k in range(60)), "dirty") for i in range(40)] + [(200, good, "dirty"), (201, bad, "clean")]
    kept = {r.doc_id: r.kept for r in host_rules.host_rules(spark.createDataFrame(text, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(40))
    assert not kept[200], "a blocked host loses all its documents"
    assert host_rules.keep_good(edge.documents(spark)).columns == edge.documents(spark).columns


def test_components_and_groups(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    split = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), hub=3).collect()}
    assert split == got, "edges of hubs are joined where they are"
    near = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [1, 0, 1, 1], [0, 0, 1, 1]], bool)
    u, v = components.spanning(near)
    assert sorted(map(sorted, zip(u.tolist(), v.tolist()))) == [[0, 2], [2, 3]]


def test_edges_of_hubs_are_not_shuffled_by_vertex(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 1, id) AS a", "id AS b")
    low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n")).withColumnRenamed("a", "v")
    joined = components.beside(rows, "a", low, "v", 100)
    assert joined.columns == ["a", "b", "v", "m"] and joined.count() == 1000
    assert joined.where("a = 1 AND m = 0").count() == 900
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "LeftAnti" in plan


def shingles(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_classes(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, width, percent):
    rng = random.Random(width)
    base = [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (120, 60, 200, 4, 2, 1)]
    rows = []
    for b in base:
        for _ in range(40):
            x = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                x[rng.randrange(len(x))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows) * 3, " ".join(x).title() if rng.random() < 0.3 else "  ".join(x)))
    rows += [(10_001, None), (10_002, ""), (10_003, "\n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how=near_dup.Similar(width, percent)).collect()}
    assert got == brute_classes(rows, width, percent)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Regions and clusters larger than a block are still compared in full."""
    for name, value in (("SMALL", 2), ("MIDDLE", 3), ("REGION_BLOCK", 5), ("BLOCK_DOCS", 7), ("PIVOTS", 1)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        x = list(base)
        for _ in range(i % 5):
            x[rng.randrange(len(x))] = f"v{i}{rng.randrange(9999)}"
        rows.append((i, " ".join(x)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how=near_dup.Similar(3, 85)).collect()}
    assert got == brute_classes(rows, 3, 85)


def test_near_duplicates_edges(spark):
    out = near_dup.near_duplicates(edge.documents(spark)).collect()
    assert len(out) == len(edge.ROWS)
    by = {r.doc_id: r for r in out}
    assert by[7].component_id == 6 and not by[7].kept and by[1].component_id == 1 and by[None].component_id is None and by[None].kept
    assert near_dup.near_duplicates(edge.empty(spark)).count() == 0
    left = near_dup.without_near_duplicates(edge.documents(spark))
    assert left.columns == edge.documents(spark).columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, None}


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one id are documents of their own, each in its own class."""
    base = {k: [f"{k}{i}" for i in range(100)] for k in "abc"}
    near = {k: " ".join([*x[:-1], "other"]) for k, x in base.items()}
    full = {k: " ".join(x) for k, x in base.items()}
    rows = [(1, full["a"]), (5, near["a"]), (5, full["b"]), (7, near["b"]), (9, full["c"]), (9, near["c"]), (11, full["c"] + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in near_dup.without_near_duplicates(df).collect()}
    assert len(left) == 3 and {(1, full["a"]), (5, full["b"])} < left and sum(i == 9 for i, _ in left) == 1
    got = sorted((r.doc_id, r.component_id, r.first_of_class) for r in near_dup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (9, 9, False), (9, 9, True), (11, 9, False)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_dup.near_duplicates(df).collect())


def brute_lines(rows, least):
    """Deletes every line inside a run of ``least`` words that occurs earlier, by the longest match with each earlier place."""
    docs = [(i, *line_dedup.split_lines((t or "").encode())) for i, t in sorted(rows)]
    seen, gone = defaultdict(list), {i: set() for i, _, _ in docs}
    for d, (i, lines, _) in enumerate(docs):
        for p in range(len(lines)):
            best = 0
            for e, o in seen[lines[p]]:
                other, n = docs[e][1], 0
                while p + n < len(lines) and o + n < len(other) and lines[p + n] == other[o + n]:
                    n += 1
                best = max(best, n)
            if sum(len(x.split()) for x in lines[p : p + best]) >= least:
                gone[i] |= set(range(p, p + best))
            seen[lines[p]].append((d, p))
    return {i: (len(lines), len(gone[i])) for i, lines, _ in docs}


@pytest.mark.parametrize("least", [1, 7, 10])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(least)
    some = ["a", "b", "c d e", "f g", "h i j k l m n o p q r", "x y z w", ""]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least).collect()}
    assert got == brute_lines(rows, least)


def test_line_dedup_edges(spark):
    passage = "this passage of more than ten words stands in several documents of the table"
    rows = [(1, f"own line one\n{passage}\nend"), (2, f"{passage}\nother words here"), (3, "other words here")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=10).collect()}
    assert got == {1: rows[0][1], 2: "other words here", 3: "other words here"}
    docs = edge.documents(spark)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_words=10).collect()}
    assert out[1].text is None and out[2].text == "" and out[6].n_removed == 0 and out[7].text == "" and out[12].n_removed == 29
    assert line_dedup.dedup_lines(edge.empty(spark)).count() == 0
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and {r.n_lines for r in kept.collect()} == {"l"} and 7 not in {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id == 8 for r in kept.collect()) == 2, "repeated rows are one document"


def test_maximal_runs_match_brute_force(spark):
    """Longest matches with an earlier place, by comparing every two places, with runs far longer than the alphabet's."""
    rng = random.Random(21)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 9))] for _ in range(25)] + [["x"] * 23, ["x"] * 9 + ["y"]]
    long = [f"l{i}" for i in range(40)]
    texts += [long, long[5:30] + ["q"] + long[3:20], ["z", *long[31:]]]
    texts = [list(x) for x in dict.fromkeys(map(tuple, texts))]
    every = [(d, p) for d, x in enumerate(texts) for p in range(len(x))]

    def same(a, b):
        n, x, y = 0, texts[a[0]], texts[b[0]]
        while a[1] + n < len(x) and b[1] + n < len(y) and x[a[1] + n] == y[b[1] + n]:
            n += 1
        return n

    best = {b: max((same(a, b) for a in every[:k]), default=0) for k, b in enumerate(every)}
    expected = {(d, p, n) for (d, p), n in best.items() if n and not best.get((d, p - 1), 0) > n}
    rows = spark.createDataFrame([(d, 0, [c.encode() for c in x]) for d, x in enumerate(texts)], "d long, t long, lines array<binary>")
    assert {(r.d, r.pos, r.len) for r in line_dedup.maximal_runs(rows).collect()} == expected


def test_line_dedup_of_many_equal_rows(spark):
    """Equal rows, rows without an id and copies under other ids are one text each, so they take no longer than others."""
    text = "\n".join(f"line number {i} of a text with some words" for i in range(20))
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    more = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    other = spark.range(10, 20_010).select(F.col("id").alias("doc_id"), F.lit(text + "\nend").alias("text"))
    got = line_dedup.dedup_lines(same.unionByName(more).unionByName(other)).groupBy(F.when(F.col("doc_id") > 10, 11).otherwise(F.col("doc_id")).alias("i"), "n_removed").count().collect()
    assert {(r.i, r.n_removed): r["count"] for r in got} == {(None, 0): 100_000, (5, 20): 20_000, (10, 20): 1, (11, 21): 19_999}


def test_line_dedup_query_cuts_every_repeated_run(spark, tmp_path):
    """Short lines are runs too: later copies of one word or of a few go like those of a passage."""
    rng = random.Random(4)
    some = ["a", "b c", "d e f g h i j k l", "m n o p q r s t u v w", ""]
    rows = [(i, "\n".join([rng.choice(some) for _ in range(rng.randint(0, 6))] + [f"own {i}"])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == brute_lines(rows, 1) != brute_lines(rows, 10)


def brute_targets(sizes, total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


def test_mixing_targets_and_rounding(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "c", "d", "é", "", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_plan(df).collect()
    assert len(out) == len(rows)
    sizes, taken, size_of = Counter(), Counter(), {}
    for i, t, s in rows:
        sizes[s] += len(t.split())
        size_of[i] = len(t.split())
    expected = brute_targets(sizes)
    for r in out:
        taken[r.source] += r.taken
        assert r.size == size_of[r.id] and r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 150, (s, taken[s], expected[s])
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert {r.id: r.taken for r in again} == {r.id: r.taken for r in out}


def test_mixing_is_unbiased(spark):
    """Over many seeds (ids) each document is taken about as often as its probability."""
    rows = [(1000 * k + i, "w " * (5 + 17 * i), f"s{k:04}") for k in range(300) for i in range(7)]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), total=0.9, most=0.9)
    mean = defaultdict(list)
    for r in out.collect():
        mean[r.id % 1000].append(r.copies)
    assert all(abs(np.mean(v) - 0.9) < 0.1 for v in mean.values()), {k: np.mean(v) for k, v in mean.items()}


def test_mixing_of_equal_rows(spark):
    """Rows that repeat, with or without an id, are rounded together: no bucket holds them all, and the words come out near the target."""
    same = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("a").alias("source"))
    more = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "x y z").otherwise("z y x").alias("text"), F.lit("a").alias("source"))
    other = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("p q r s").alias("text"), F.lit("b").alias("source"))
    df = same.unionByName(more).unionByName(other)
    out = mixing.mix_plan(df, total=0.7, most=0.9)
    got = {r.source: r for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.min("target").alias("target"), F.max("copies").alias("most")).collect()}
    assert got["a"].n == 40_000 and got["b"].n == 2_000 and got["a"].most == got["b"].most == 1
    assert all(abs(r.taken - r.target) <= 5 for r in got.values())
    words = {r.source: r.taken for r in mixing.mixed(df, total=0.7, most=0.9).groupBy("source").agg(F.sum(mixing.n_words("text")).alias("taken")).collect()}
    assert all(abs(words[s] - r.target) < 0.02 * r.target for s, r in got.items())


def test_mixing_edges(spark):
    docs = edge.documents(spark)
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(edge.ROWS) and {r.taken for r in out if r.id in (1, 2, 3)} == {0}
    assert mixing.mix_plan(edge.empty(spark)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(edge.empty(spark)).count() == 0


def test_words_helper():
    data = np.frombuffer(b"ab ab\n\tcdab", np.uint8)
    starts, ends, first = words.word_spans(data, np.array([0, 5, 5, 9, 11]))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"ab", b"cd", b"ab"] and first.tolist() == [0, 2, 2, 3, 4]
    h = words.word_hashes(data, starts, ends)
    assert h[0] == h[1] == h[3] != h[2]


@pytest.mark.parametrize("extra", [0, 1])
def test_equal_rows_are_taken_as_often_as_planned_however_they_are_dealt(spark, extra):
    """A thousand equal rows, some of them different in another column: always the plan's number, and the same rows."""
    rows = [(1, "one two three four five", "a", i % (1 + 2 * extra)) for i in range(1000)] + [(2, "six seven " * 900, "b", 0), (3, "eight " * 4000, "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    planned = Counter()
    for r in mixing.mix_plan(df).collect():
        planned[r.id] += r.copies
    assert 0 < planned[1] % 1000
    seen = [Counter(map(tuple, mixing.mixed(x).collect())) for x in (df.repartition(1), df.repartition(3), df.repartition(7, "other"))]
    assert seen[0] == seen[1] == seen[2]
    assert Counter({k: sum(n for r, n in seen[0].items() if r[0] == k) for k in (1, 2, 3)}) == Counter({k: planned[k] for k in (1, 2, 3)})
