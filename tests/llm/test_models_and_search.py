"""Classifiers by held-out accuracy, BPE against the reference tokeniser, search and pages against brute force."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from candela.llm import bitsliced, bpe, html_layout, lang_kernel, quotes, rff_quality, words
from candela.llm.common import fold, unit_hash

from . import edge


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(tokenizer):
    rng = random.Random(1)
    parts = ["'", "'s", "'ll", "'re", "s", "t", "re", "ve", "m", "l", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", " '", " ", "　", "\x85", "\x1c", "中", "😀", "’", "́", "'ve", "'d", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)] + ["", "a" * 3000, "ab" * 300, "'" * 90, " " * 500]
    v = bpe.vocabulary(bpe.public_path())
    for i, j, data, off in words.chunks(pa.array([t.encode() for t in texts]), 4096):
        ids, doc = bpe.encode_chunk(v, data, off)
        back, at = bpe.decode_chunk(v, ids, doc)
        for k in range(j - i):
            assert ids[doc[k] : doc[k + 1]].tolist() == tokenizer.encode_ordinary(texts[i + k])
            assert back[at[k] : at[k + 1]] == texts[i + k].encode()


def test_bpe_digest_and_round_trip(spark, tokenizer):
    docs = edge.documents(spark)
    out = bpe.digest(docs, bpe.public_path(), keep=["doc_id"]).collect()
    assert len(out) == len(edge.ROWS)
    text = {r[0]: r[1] or "" for r in edge.ROWS}
    for r in out:
        ids = tokenizer.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    encoded = bpe.encode(docs.where("doc_id < 12"), bpe.public_path(), keep=["doc_id"])
    assert {(r.doc_id, r.text) for r in bpe.decode(encoded, bpe.public_path()).collect()} == {(i, t) for i, t in text.items() if i is not None and i < 12}
    assert bpe.encode(docs.where("doc_id = 5"), bpe.public_path(), keep=["doc_id"]).first().starts == [0, 3, 7]
    assert bpe.digest(edge.empty(spark), bpe.public_path()).count() == 0


def test_invalid_utf8_counts_as_replacement(spark, tokenizer):
    """A Spark string may hold any bytes; no operator that reads it as text fails on them."""
    from candela.llm import line_dedup

    df = spark.createDataFrame([(1, bytearray(b"ab\xff\xfecd \xe4\xb8 x")), (2, bytearray(b"a\nline\xc3\na\nline\xc3"))], "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS STRING) AS text")
    as_read = {r.doc_id: bytes(r.b).decode("utf-8", "replace") for r in df.selectExpr("doc_id", "CAST(text AS BINARY) AS b").collect()}
    for r in bpe.digest(df, bpe.public_path()).collect():
        assert r.n_tokens == len(tokenizer.encode_ordinary(as_read[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(as_read[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {1: as_read[1], 2: "a\nline\ufffd"}
    assert [r.out for r in html_layout.rendered(df.select("text"), "text", "out").collect()][0] == as_read[1]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (900, 9))
    x[100:400] = x[100]  # ties in plenty
    rows = [(i * 10, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [(7, None), (9, [1.0, float("nan")]), (11, [None, 1.0]), (13, [float("inf")]), (15, []), (17, [0.5]), (None, [0.1] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in bitsliced.top_k(df, df.where("vec_id % 50 = 0"), 5, block_rows=200, chunk_queries=64).collect())
    z = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    z = {i: np.pad(v, (0, 9 - len(v))) for i, v in z.items()}
    expected = []
    for q in sorted(i for i in z if i % 50 == 0):
        best = sorted((-int(v @ z[q]), i) for i, v in z.items() if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == expected
    assert bitsliced.top_k(df.limit(0), df.limit(0), 5).count() == 0
    few = df.where("vec_id < 30")
    assert bitsliced.top_k(few, few.where("vec_id = 0"), 5).count() == 3


def test_top_k_of_repeated_rows_and_large_components(spark):
    """Repeated rows are one row and one query; of different vectors under an id the smallest counts; clashing columns are ignored."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-4, 5, 3)]) for i in range(0, 400, 10)]
    more = rows + rows[:20] * 3 + [(i, [v[0] + 1, *v[1:]]) for i, v in rows[::4]]
    shape = "vec_id long, embedding array<double>, id string, v string, block long, score long, chunk long, lane long"
    table = lambda r: spark.createDataFrame([(*x, "a", "b", 1, 2, 3, 4) for x in r], shape)
    search = lambda df: sorted(map(tuple, bitsliced.top_k(df, df.where("vec_id % 50 = 0"), 5, block_rows=16, chunk_queries=3).collect()))
    assert search(table(more)) == search(table(rows)) and len(search(table(rows))) == 8 * 5
    con = duckdb.connect()
    con.register("embeddings", table(more).select("vec_id", "embedding").toArrow())
    assert search(table(more)) == sorted(con.execute(bitsliced.SQL).fetchall())
    big = table([(0, [1e6, -1e6]), (1, [8e6, 8e6]), (50, [-8e6, 1.0]), (51, [0.0])])
    z = {r.vec_id: [int(256 * c) for c in r.embedding] for r in big.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(z[a], z[b]))
    assert search(big) == sorted((q, k + 1, i, -s) for q in (0, 50) for k, (s, i) in enumerate(sorted((-dot(q, i), i) for i in z if i != q)))
    assert search(table([(0, [1e30]), (1, [1e30])])) == [(0, 1, 1, 2**63 - 1)]


def test_quality_held_out(spark, data):
    out = rff_quality.query(spark, f"{data}/sf0.01").toPandas()
    labels = spark.read.parquet(f"{data}/sf0.01/labels.parquet").toPandas()
    x = out.merge(labels, on="doc_id")
    x = x[x.held_out]
    good, bad = x[x.quality == 1].score.to_numpy(), np.sort(x[x.quality == 0].score.to_numpy())
    auc = (np.searchsorted(bad, good) + np.searchsorted(bad, good, "right")).mean() / 2 / len(bad)
    assert auc > 0.97 and (x.predicted == x.quality).mean() > 0.95 and out.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = edge.documents(spark)
    none = spark.createDataFrame([], "id long, y int")
    assert {r.score for r in rff_quality.quality_scores(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(6, 1), (8, 1), (12, 0), (13, 0), (1, None), (999, 1), (6, 7)], "id long, y int")
    out = rff_quality.quality_scores(docs, some).collect()
    assert len(out) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in out)
    assert rff_quality.quality_scores(edge.empty(spark), some).count() == 0
    at, level = rff_quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 3, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert (np.diff(level) >= 0).all() and len(at) == 3


def test_calibration_increases_for_bins_of_any_size():
    _, level = rff_quality.isotonic(np.array([0.0, 1, 2]), np.array([10.0, 900, 1]), np.array([100.0, 1000, 1]))
    assert (np.diff(level) > 0).all() and level[0] < 0.2 < 0.8 < level[-1]
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = rng.integers(1, 10 ** rng.integers(1, 4), rng.integers(1, 30)).astype(float)
        at, level = rff_quality.isotonic(np.arange(len(n), dtype=float), np.floor(n * rng.random(len(n))), n)
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all() and ((level > 0) & (level < 1)).all()


@pytest.mark.parametrize("ids", [[None], [7], [7, 8]])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    texts = {"en": "the house of many words {} and others", "de": "das haus der vielen wörter {} und andere"}
    rows = [(ids[i % len(ids)], texts[k].format(i % 40), k) for i in range(1500) for k in texts]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    out = lang_kernel.languages(df, lang_kernel.fit(df), "id").groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in out} == {"en": 1500, "de": 1500}
    alike = df.select("id", F.lit("one text").alias("text"), "lang")
    assert lang_kernel.fit(alike) is not None


def test_wide_components_are_scored_exactly(spark):
    """Components beyond 32 bits, scores beyond 64."""
    rng = np.random.default_rng(5)
    for size in (2.0**30, 2.0**45):
        x = (rng.random((60, 3)) - 0.5) * size
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        v = [[int(np.floor(256 * c)) for c in r] for r in x]
        want = []
        for q in range(0, 60, 20):
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in range(60) if i != q)[:5]
            want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
        got = bitsliced.top_k(rows, rows.where("vec_id % 20 = 0"), 5)
        assert sorted(map(tuple, got.collect())) == want and got.schema["score"].dataType.typeName() == "long"


def test_turns_with_gaps_answer_the_message_before(spark):
    rows = [(1, t, "user", f"message {t}") for t in (0, 2, 5, 5000, 90_000)] + [(2, 3, "user", "other")]
    out = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth) for r in quotes.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {(1, 0): (None, 0, 0), (1, 2): (0, 0, 1), (1, 5): (2, 0, 2), (1, 5000): (5, 0, 3), (1, 90_000): (5000, 0, 4), (2, 3): (None, 3, 0)}


def test_quality_matches_a_dense_solution(spark, data):
    """Scores of the distributed fit against one matrix of all labelled rows, solved and calibrated in numpy."""
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/sf0.01/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    got = {r.id: r.score for r in rff_quality.quality_scores(docs, labels).collect()}
    stats = rff_quality.text_stats(docs, "doc_id", "text").toPandas()
    x = np.stack(stats.x.to_numpy())
    known = labels.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(rff_quality.FOLDS))).toPandas().merge(stats, on="id")
    kx, y, k = np.stack(known.x.to_numpy()), known.y.to_numpy(float), known.fold.to_numpy()
    z = rff_quality.Fourier(kx.mean(0), kx.std(0), rff_quality.FEATURES, rff_quality.GAMMA)

    def ridge(rows):
        a = z(kx[rows])
        penalty = rff_quality.RIDGE * len(a) * np.eye(a.shape[1])
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a.T @ a + penalty, a.T @ y[rows])

    raw = np.zeros(len(y))
    for f in range(rff_quality.FOLDS):
        raw[k == f] = z(kx[k == f]) @ ridge(k != f)
    bins = np.clip(((raw + 0.5) / 2 * rff_quality.BINS).astype(int), 0, rff_quality.BINS - 1)
    used = np.unique(bins)
    good, n = np.array([y[bins == b].sum() for b in used]), np.array([(bins == b).sum() for b in used])
    # isotonic regression as the largest of all minima over means of intervals
    fit = np.array([max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(at, len(used))) for i in range(at + 1)) for at in range(len(used))])
    centre, value = (used + 0.5) / rff_quality.BINS * 2 - 0.5, []
    for v in np.unique(fit):
        same = fit == v
        value.append(((centre[same] * n[same]).sum() / n[same].sum(), (good[same].sum() + 0.5) / (n[same].sum() + 1), n[same].sum()))
    while (fall := next((i for i in range(len(value) - 1) if value[i][1] >= value[i + 1][1]), None)) is not None:  # levels out of order after the shrinkage
        (a, g, m), (b, h, k) = value[fall : fall + 2]
        value[fall : fall + 2] = [((a * m + b * k) / (m + k), (g * m + h * k) / (m + k), m + k)]
    value = [v[:2] for v in value]
    knots, level = zip((-1.0, 0.0), *value, (2.0, 1.0))
    expected = np.interp(z(x) @ ridge(np.ones(len(y), bool)), knots, level)
    assert max(abs(got[i] - e) for i, e in zip(stats.id, expected)) < 2e-3


def test_languages_held_out_and_edges(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    out = lang_kernel.query(spark, f"{data}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    awkward = edge.documents(spark)
    model = lang_kernel.fit(docs.where(fold("doc_id") != 2).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = {r.id: r for r in lang_kernel.languages(awkward, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 13} and got[6].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert lang_kernel.fit(docs.where("lang = 'none'").select(F.col("doc_id").alias("id"), "text", "lang")) is None
    assert {r.lang_pred for r in lang_kernel.languages(awkward, None).collect()} == {"und"}
    assert lang_kernel.languages(edge.empty(spark), model).count() == 0


def test_languages_match_a_dense_solution(spark):
    """Where every row is a landmark, the Nystroem model is kernel ridge regression: solved here on the n-grams themselves."""
    rng = random.Random(5)
    words_of = {k: ["".join(rng.choice(c) for _ in range(rng.randint(2, 6))) for _ in range(60)] for k, c in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnab"))}
    rows = [(i, " ".join(rng.choice(words_of[k]) for _ in range(rng.randint(3, 15))), k) for i, k in enumerate(["aa"] * 25 + ["bb"] * 15 + ["cc"] * 10)]
    asked = [" ".join(rng.choice(words_of[k]) for _ in range(4)) for k in words_of for _ in range(15)]
    model = lang_kernel.fit(spark.createDataFrame(rows, "id long, text string, lang string"), landmarks=100)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    sets = [grams(lang_kernel.normal(t.encode())) for _, t, _ in rows]
    at = {g: i for i, g in enumerate(sorted(set().union(*sets)))}

    def dense(some):
        z = np.zeros((len(some), len(at)))
        for row, s in zip(z, some):
            row[[at[g] for g in s if g in at]] = 1
        return z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))

    z, langs = dense(sets), sorted(words_of)
    y = np.array([[1.0 if k == lang else -1.0 for k in langs] for _, _, lang in rows])
    penalty = lang_kernel.RIDGE * len(rows) / (np.linalg.matrix_rank(z) + 1)
    a = np.column_stack([z, np.ones(len(z))])
    w = np.linalg.solve(a.T @ a + np.diag([penalty] * len(at) + [1e-9]), a.T @ y)
    f = dense([grams(lang_kernel.normal(t.encode())) for t in asked]) @ w[:-1] + w[-1]
    names, scores = model.predict([t.encode() for t in asked])
    e = np.exp(4 * (f - f.max(1, keepdims=True)))
    assert names == [langs[i] for i in f.argmax(1)] and np.abs(scores - 1 / e.sum(1)).max() < 5e-3


def test_rare_language_of_a_large_table_is_learnt(spark):
    """A dozen rows among 40,000, none of which a uniform sample of half the rows would hold."""
    rng = random.Random(8)
    words_of = {k: ["".join(rng.choice(c) for _ in range(rng.randint(2, 7))) for _ in range(200)] for k, c in (("en", "abcdefghilmnorst"), ("zz", "aekjqvwxyzu"))}
    say = lambda k: " ".join(rng.choice(words_of[k]) for _ in range(12))
    ids = [r.id for r in spark.range(100_000, 100_200).where(unit_hash("id", seed=3) > 0.6).limit(12).collect()]
    rows = [(i, say("en"), "en") for i in range(40_000)] + [(i, say("zz"), "zz") for i in ids]
    model = lang_kernel.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    asked = ["zz"] * 20 + ["en"] * 20
    assert model.predict([say(k).encode() for k in asked])[0] == asked


HTML = [
    ("<p>a<p>b <b>c</b>  d", "a\n\nb c d"),
    ("<ul><li>x<li>y<ol start=3><li>z<li>w</ol></ul>", "- x\n- y\n  3. z\n  4. w"),
    ("<table><tr><th>name<th>n<tr><td>aa<td>1<tr><td>b<td colspan=2>long cell</table>", "name  n\naa    1\nb     long cell"),
    ("<pre> x\n   y</pre>", " x\n   y"),
    ("a<br>b<div hidden>no</div><div style='display: none'>no</div><div>q</div>", "a\nb\nq"),
    ("<script>var t='</p>'</script><style>p{}</style><!-- <p>no</p> -->yes &lt;b&gt; &copy;", "yes <b> ©"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("a < b <unclosed 'quote> c", "a < b c"),
    ("</p></div>text</span>", "text"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("", ""),
]


@pytest.mark.parametrize("page,text", HTML)
def test_html_layout(page, text):
    assert html_layout.render(page) == text


IMPLIED = [
    ("<html><head><title>t</title><meta charset=utf-8><body><p>a", "a"),
    ("<head><style>p{}</style><link rel=x>\n<p>a<p>b", "a\n\nb"),
    ("<head><title>t</title> text", "text"),
    ("<head><template><p>no</template><script>no</script></head>yes", "yes"),
    ("<table><colgroup><col><col><tr><td>a<td>b</table>", "a  b"),
    ("<table><caption>c<colgroup><col><tbody><tr><td>a</table>", "c\na"),
    ("<table><colgroup>x<thead><tr><td>a</table>", "x\n\na"),
    ("<table><tbody>x<tr>y<td>a</td>z</table>w", "xyz\n\na\n\nw"),
    ("<table><tbody><p>x</p><tr><b>y</b><td>a</table>", "x\n\ny\n\na"),
    ("<table><tr><form><td>a<td>b</form><tr><td>c</table>", "a  b\nc"),
    ("<table><form hidden><tr><div>x<td>a</div><td>b</table>", "x\n\na  b"),
    ("<table><tr><td><p>a<tr><td>b</table>", "a\nb"),
    ("<table><td>a<td>b</table>", "a  b"),
    ("<table><tr><td>a<table>x<tr><td>b</table>c</table>", "ax\nb\nc"),
    ("<table><tr><table><tr><td>a</table>b", "a\n\nb"),
]


@pytest.mark.parametrize("page,text", IMPLIED)
def test_html_implied_ends_and_loose_content(page, text):
    assert html_layout.render(page) == text


HOSTILE = [
    ("<div>" * 205 + "<script>var secret=1;</script>" + "<div hidden>secret</div>" + "seen", "seen"),
    ("<script src=x/>secret()</script>seen<div hidden/>secret</div>", "seen"),
    ("<script>secret()</script >seen<style>secret", "seen"),
    ("<svg><text>drawn</text><title>no</title><desc>no</desc></svg> <math><mi>x</mi></math>", "drawn x"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
    ("<div style='display:none'>no <b style='visibility:visible;display:block'>no</b></div>a", "a"),
    ("<div hidden style='display:block'>yes</div><p style='display:none;display:inline'>on</p>", "yes\n\non"),
    ("<dialog>no</dialog><dialog open>d</dialog><details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "d\ns\nt\nu"),
    ("<table><tr><td colspan='\u00b2'>a<td>b<tr><td colspan=" + "9" * 5000 + ">c<td>d</table>", "a  b\nc  d"),
    ("<ol start='--5'><li>a</ol><ol start=-5><li>b<li value=7>c<li>d</ol>", "1. a\n\n-5. b\n7. c\n8. d"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>A<td rowspan=2>B<br>B2<tr><td>C<td>D</table>", "A  B\n   B2\nC      D"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d</table>", "a  b\n   c\nd"),
    ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>a<tr hidden><td>no</table>", "a"),
    ("<a href=\"x>one</a> two", "one two"),
    ("<p title='a > b' data-x=\"'>\">t</p><!-->c<!--->d<!-- > -- > no -->e</ >f</3>g", "t\n\ncdefg"),
    ("<ul><li><ul><li>a<li>b</ul><li>c<li></ul>", "- - a\n  - b\n- c"),
    ("<blockquote><p>a<p>b</blockquote>c<ul><li><p>d<p>e</ul>", "  a\n\n  b\n\nc\n\n- d\n\n  e"),
    ("a<br><br>b<pre>\n x<b>y</b>\n  z\n</pre><hr>", "a\n\nb\n\n xy\n  z\n\n" + "-" * 20),
    ("<textarea>&lt;b> <i></textarea>", "<b> <i>"),
    ("<", "<"), ("</", "</"), ("<a", ""), ("a<b", "a"), ("<!", ""), ("<!--", ""), ("&#xD800;&#0;&bogus;", "\ufffd\ufffd&bogus;"), ("<table>", ""), ("<tr><td>a</tr></table>b", "a\nb"),
]


@pytest.mark.parametrize("page,text", HOSTILE)
def test_html_hostile_pages(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize("unit,end", [("<a ", ""), ("<a <b x=", '">'), ("<b>", ""), ("<b><i></b>", ""), ("<table><tr><td>x", ""), ("<ul><li>x", ""), ("<blockquote>x", ""), ("<p>x</i></div>", ""), ("<script>", ""), ("</script ", "<script>"), ("<tr><td colspan=1000 rowspan=65534>x", "</table>"), ("<!--", ""), ("<td>x<tr>", ""), ("<a b='><a c=\"", ">"), ("<form><p>", "x"), ("<details><dialog>", "")])
def test_html_takes_linear_time(unit, end):
    """300 KB of one construct, alone and inside a table, takes seconds at most, and the text stays in proportion to it."""
    import time

    for start in ("", "<table><tr><td>"):
        began = time.process_time()
        text = html_layout.render(start + unit * (300_000 // len(unit)) + end)
        assert time.process_time() - began < 12 and len(text) < 10_000_000


def test_html_padding_is_bounded():
    wide = "<table><tr><td>" + "w" * 100_000 + "<td>a" + "<tr><td>b<td>c" * 1000 + "</table>"
    text = html_layout.render(wide)
    assert len(text) < 1_000_000 and text.split("\n")[5] == "b  c" and html_layout.render("<table><tr><td>long cell<td>a<tr><td>b<td>c</table>").split("\n")[1] == "b          c"


GAP = None


def second_layout(node, item=False):
    """The layout of a tree (tag, attributes, children) as a list of lines, with GAP where an empty line is due: an independent version, by recursion."""
    tag, attrs, kids = node
    out, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    def scope(lines):
        while lines and lines[0] is GAP:
            lines = lines[1:]
        while lines and lines[-1] is GAP:
            lines = lines[:-1]
        return lines

    def marked(first, lines):
        rest = " " * len(first)
        return [s if s is GAP else (rest if i else first) + s for i, s in enumerate(lines)]

    n = int(attrs.get("start", 1))
    for k in kids:
        if isinstance(k, str):
            now.append(k)
            continue
        t, a, rows = k
        if "hidden" in a:
            continue
        if t == "b" or t == "i":
            now.append(second_text(k))
            continue
        flush()
        gap = [GAP] * (t in ("p", "blockquote", "table") or t in ("ul", "ol") and not item)
        if t == "li":
            lines = marked(f"{n}. " if tag == "ol" else "- ", scope(second_layout(k, True)))
            n += 1
        elif t == "blockquote":
            lines = marked("  ", scope(second_layout(k)))
        elif t == "table":
            cells = [[[x for x in second_layout(c) if x is not GAP] for c in row[2]] for row in rows]
            width = [max((len(x) for r in cells if j < len(r) for x in r[j]), default=0) for j in range(max(map(len, cells)))]
            lines = []
            for r in cells:
                for i in range(max(map(len, r))):
                    lines.append("  ".join((r[j][i] if j < len(r) and i < len(r[j]) else "").ljust(w) for j, w in enumerate(width) if w).rstrip())
        else:
            lines = second_layout(k, item)
        out += [*gap, *lines, *gap]
    flush()
    return out


def second_text(node):
    return "".join(k if isinstance(k, str) else "" if "hidden" in k[1] else second_text(k) for k in node[2])


def test_html_layout_of_random_trees():
    """Against a second version that lays out the tree itself, never its markup."""
    rng = random.Random(12)

    def made(tag, depth, kinds):
        attrs = {"hidden": ""} if rng.random() < 0.08 and tag not in ("td", "tr", "root") else {"start": str(rng.randint(1, 20))} if tag == "ol" else {}
        if tag == "table":
            return tag, {}, [("tr", {}, [made("td", depth - 1, kinds) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))]
        if tag in ("ul", "ol"):
            return tag, attrs, [made("li", depth - 1, kinds) for _ in range(rng.randint(0, 3))]
        kids = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(["text", "text", *(kinds if depth > 0 and tag not in ("p", "b", "i") else ["b", "i"] if depth > 0 else ["text"])])
            kids.append(rng.choice(["a", "bb ", " c c", "  ", "dd"]) if t == "text" else made(t, depth - 1, kinds))
        return tag, attrs, kids

    def page(node):
        tag, attrs, kids = node
        inner = "".join(k if isinstance(k, str) else page(k) for k in kids)
        return inner if tag == "root" else f"<{tag}" + "".join(f' {k}="{v}"' for k, v in attrs.items()) + f">{inner}</{tag}>"

    for _ in range(3000):
        root = made("root", 4, ["div", "p", "ul", "ol", "blockquote", "table", "b"])
        lines, text = second_layout(root), ""
        for i, x in enumerate(lines):
            if x is not GAP:
                text += ("" if not text else "\n\n" if lines[i - 1] is GAP else "\n") + x
        assert html_layout.render(page(root)) == text, page(root)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "u", "t"), (2, "<p>x", None, "t"), (2, "<p>x", None, "t"), (3, "<b>" * 20_000 + "y", "u", "t")], "page_id long, html string, url string, text string")
    assert sorted((r.page_id, r.text) for r in html_layout.rendered(df).collect() if r.text) == [(2, "x"), (2, "x"), (3, "y")]
    assert html_layout.rendered(df).where("page_id = 1 AND text IS NULL").count() == 1 and html_layout.rendered(df.limit(0)).count() == 0


def test_all_visible_words_are_kept(data):
    import re

    pages = duckdb.sql(f"SELECT html FROM '{data}/sf0.001/pages.parquet'").fetchall()
    for (page,) in pages:
        body = re.sub(r"(?s)<(head|script|style|noscript|template)\b.*?</\1>|<!--.*?-->", " ", page)
        import html

        expected = html.unescape(re.sub(r"<[^>]*>", " ", body)).replace(" ", " ").split()
        got = [w for w in html_layout.render(page).split() if not re.fullmatch(r"-+|\d+\.", w)]
        assert "".join(got) == "".join(w for w in expected if not re.fullmatch(r"-+|\d+\.", w))


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are  you?"), (1, 1, "assistant", "I am fine.\nAnd you?"), (1, 2, "user", "On Monday someone wrote:\n> how are you?\nWell."),
        (1, 3, "assistant", "> Well.\n>> How are you?\n> > I am fine.\nBye"), (1, 4, "user", "> nobody said this\nx"), (2, 0, None, None), (2, 5, "user", "> well."), (2, 5, "user", "> well."), (None, None, "user", ">"), (None, 3, "user", "x"), (3, None, "user", "> x"),
        # re-wrapped, in part, said twice, and a reply of a reply
        (4, 0, "user", "The first paragraph has\nthree lines of text and\nends here. One more sentence.\n\nThanks."), (4, 1, "assistant", "> The first\n> paragraph has three lines of text\n> and ends here. One more sentence.\nYes.\n\nThanks."),
        (4, 2, "user", "> one more\n> sentence.\nNo."), (4, 3, "assistant", "> Thanks.\nWelcome."), (4, 4, "user", ">> One more sentence.\n> no.\n\n\n\nBut why?"), (4, 5, "user", "> ends here.\n\n> Thanks.\nA"), (4, 7, "user", "later"), (4, 8, "user", ""),
    ]
    shape = "conv_id long, turn long, role string, text string, reply_to string, thread string, depth string, lines string, passages string, origin string, hash string"
    df = spark.createDataFrame([(*r, *"zzzzzzz") for r in rows], shape)
    result = quotes.chat(df).collect()
    out = {(r.conv_id, r.turn): r for r in result}
    assert len(result) == len(rows) and quotes.chat(df.limit(0)).count() == 0
    assert out[1, 2].reply_to == 0 and out[1, 2].text == "Well." and out[1, 2].n_linked == 1
    assert out[1, 3].reply_to == 2 and out[1, 3].n_linked == 2 and out[1, 3].text == "Bye" and out[1, 3].n_quoted == 2
    assert out[1, 4].reply_to == 3 and out[1, 4].n_linked == 0
    assert out[2, 0].role == "unknown" and out[2, 0].text == "" and out[2, 5].reply_to is None and out[None, None].reply_to is None
    assert {t: out[4, t].reply_to for t in (1, 2, 3, 4, 5, 7, 8)} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 1, 7: None, 8: 7}
    assert {t: (out[4, t].thread, out[4, t].depth) for t in range(9) if t != 6} == {0: (0, 0), 1: (0, 1), 2: (0, 1), 3: (0, 2), 4: (0, 2), 5: (0, 2), 7: (7, 0), 8: (7, 1)}
    assert out[4, 4].text.strip() == "But why?"
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    expected = con.execute(quotes.SQL)
    names = [d[0] for d in expected.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in result))) == sorted(map(repr, expected.fetchall()))


def test_threads_of_a_long_conversation(spark, monkeypatch):
    """A chain of answers and a passage that every second message says: doubling and spans give what a walk gives."""
    monkeypatch.setattr(quotes, "SPAN", 16)
    rng = random.Random(6)
    rows, reply, said = [], {}, {}
    for t in range(0, 300):
        text = [rng.choice(["the same words", f"words of {t}", f"and {t}"])]
        ask = rng.choice([None, "the same words", f"words of {rng.randrange(300)}"])
        reply[t] = said.get(ask, t - 1 if t else None)
        rows.append((1, t, "user", "\n".join(([f"> {ask}"] if ask else []) + text)))
        said[text[0]] = t
    depth, thread = {}, {}
    for t, r in reply.items():
        depth[t], thread[t] = (0, t) if r is None else (depth[r] + 1, thread[r])
    out = {r.turn: r for r in quotes.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (r.reply_to, r.thread, r.depth) for t, r in out.items()} == {t: (reply[t], thread[t], depth[t]) for t in reply}
