"""Index segments against a rebuild, text scores against plain tables, quantised search and hops on odd inputs."""

import math
import random

import pytest

from tesselon.operators import hops, index, pq, similarity

random.seed(21)
WORDS = [f"w{i}" for i in range(60)]


def text():
    return " ".join(random.choice(WORDS) for _ in range(random.randint(0, 25)))


def scores(spark, path, asked):
    return {(r.query_id, r.doc_id): (round(r.score, 5), tuple(r.matched_terms)) for r in index.search(spark, path, asked).collect()}


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(q, random.choice(WORDS)) for q in range(6) for _ in range(3)], "query_id int, term string")


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def test_segments_equal_a_rebuild(spark, asked, tmp_path):
    path, docs = f"file://{tmp_path}/index", {}
    for step in range(3):
        new = {random.randint(0, 40): text() for _ in range(15)} | {100 + step: None}
        docs |= new
        index.append(frame(spark, new), path)
        gone = random.sample(sorted(docs), 4) + [999]
        index.delete(spark.createDataFrame([(d,) for d in gone] + [(None,)], "doc_id long"), path)
        docs = {d: t for d, t in docs.items() if d not in gone}
        fresh = index.build(frame(spark, docs), f"file://{tmp_path}/fresh{step}")
        assert scores(spark, path, asked) == scores(spark, fresh, asked)
        kept = {(r.term, r.df, round(r.idf, 9), r.n, round(r.avgdl, 9)) for r in index.statistics(spark, path).collect()}
        assert kept == {(r.term, r.df, round(r.idf, 9), r.n, round(r.avgdl, 9)) for r in index.statistics(spark, fresh).collect()}
    before = scores(spark, path, asked)
    index.compact(spark, path)
    index.vacuum(spark, path)
    assert len(index.manifest(spark, path)) == 1 and scores(spark, path, asked) == before
    index.delete(spark.createDataFrame([(d,) for d in docs], "doc_id long"), path)
    assert scores(spark, path, asked) == {} and index.statistics(spark, path).count() == 0


def test_an_uncommitted_segment_is_not_seen(spark, asked, tmp_path, monkeypatch):
    path = index.append(frame(spark, {1: "w1 w2", 2: "w3"}), f"file://{tmp_path}/index")
    before, version = scores(spark, path, asked), index.manifest(spark, path)
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.append(frame(spark, {1: "w9 w9", 3: "w1"}), path)
    monkeypatch.undo()
    assert index.manifest(spark, path) == version and scores(spark, path, asked) == before


def test_repeated_ids_and_empty_appends(spark, tmp_path):
    rows = [(1, "alpha beta"), (1, "beta gamma gamma"), (2, "beta"), (None, "beta"), (3, ""), (4, None)]
    path = index.append(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/index")
    got = {r.term: (r.df, r.n, r.avgdl) for r in index.statistics(spark, path).collect()}
    assert got["beta"] == (2, 2, 3.0) and got["gamma"][0] == 1
    index.append(spark.createDataFrame([], "doc_id long, text string"), path)
    assert {r.term: (r.df, r.n, r.avgdl) for r in index.statistics(spark, path).collect()} == got
    empty = index.append(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert index.search(spark, empty, spark.createDataFrame([(1, "beta")], "query_id int, term string")).count() == 0


def test_index_of_a_changed_table_is_built_anew(spark, tmp_path):
    at = f"file://{tmp_path}/docs"
    asked = spark.createDataFrame([(1, "new")], "query_id int, term string")
    frame(spark, {1: "old"}).write.parquet(at)
    first = index.built(spark.read.parquet(at), at)
    assert index.built(spark.read.parquet(at), at) == first
    frame(spark, {2: "new one"}).write.mode("append").parquet(at)
    assert [r.doc_id for r in index.search(spark, index.built(spark.read.parquet(at), at), asked).collect()] == [2]


def test_each_share_of_documents_has_a_file_of_its_own(spark, tmp_path, monkeypatch):
    """No task sorts two shares by the chance of a hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(index, "TASK_BYTES", 100, raising=False)
    path = index.append(frame(spark, {i: f"w{i} w{i % 7} common" for i in range(90)}), f"file://{tmp_path}/index")
    shares = -(-sum(len(f"w{i} w{i % 7} common") for i in range(90)) // 100)
    held = spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("file"), F.pmod(F.hash("doc_id"), F.lit(shares)).alias("share")).distinct().collect()
    assert len(held) == len({r.file for r in held}) == len({r.share for r in held}) > shares // 2


def test_inverted_file_search_of_all_cells_is_exact(spark, tmp_path, monkeypatch):
    from tesselon.operators import ivf, retrieval

    monkeypatch.setattr(ivf, "STREAM_ROWS", 16, raising=False)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)], 0) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = v.where("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as q", "0 as ql")
    c = ivf.fit(v, 6)
    key = lambda d: sorted((r.query_id, r.rank, r.vec_id, round(r.score, 5)) for r in d.collect())
    got = ivf.search(q, ivf.build(v, c, f"file://{tmp_path}/ivf"), c, 4, 6)
    assert key(got) == key(retrieval.dense_search(q, v, 4)) and "lambdafunction" not in got._jdf.queryExecution().toString()


# ---------------------------------------------------------------- hops


def test_hops_follow_rare_shared_terms(spark, tmp_path):
    docs = {1: "question alpha bridge1 filler", 2: "bridge1 bridge2 filler", 3: "bridge2 answer filler", 4: "filler unrelated", 5: None, 6: "filler other"}
    path = index.append(frame(spark, docs), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(7, "question"), (8, "absent")], "query_id int, term string")
    got = {(r.query_id, r.hop, r.doc_id): (r.via, r.path) for r in hops.multi_hop(frame(spark, docs), path, asked, width=1, bridging=1).collect()}
    assert got == {(7, 1, 1): (None, "1"), (7, 2, 2): (1, "1>2"), (7, 3, 3): (2, "1>2>3")}


# ---------------------------------------------------------------- scores of texts


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_common_subsequence_equals_the_table():
    for n in (0, 1, 2, 7, 63, 64, 65, 130):
        for m in (0, 1, 5, 64, 200):
            for letters in ("ab", "abcdefghijklmnop"):
                a, b = [random.choice(letters) for _ in range(n)], [random.choice(letters) for _ in range(m)]
                assert similarity.common_length(a, b) == plain_common(a, b)


def test_rouge_of_long_texts_that_differ_late(spark):
    a = [f"x{i % 700}" for i in range(10_000)]
    b = a[:9_990] + ["other"] * 10
    got = spark.createDataFrame([(1, a, a), (2, a, b), (3, a, []), (4, None, b), (5, [], [])], "k int, a array<string>, b array<string>")
    got = {r.k: (r.exact_match, r.rouge_l) for r in similarity.rouge_l(got).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.999), 3: (False, 0.0), 4: (False, 0.0), 5: (True, 0.0)}


def test_token_alignment_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rows = [(i, [random.choice(WORDS + ["é", "running", "runner"]) for _ in range(random.randint(0, 12))], [random.choice(WORDS + ["runs", "é"]) for _ in range(random.randint(0, 12))]) for i in range(30)] + [(90, [], []), (91, None, ["w1"])]
    got = {r.k: (r.precision, r.recall, r.f1) for r in similarity.bert_score(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), ["k"]).collect()}
    vectors = similarity.TokenVectors()
    df = {}
    for _, _, b in rows:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((len(rows) + 1) / (df.get(w, 0) + 1))
    for k, a, b in rows:
        side = lambda x, y: sum(idf(w) * max(float(vectors[w] @ vectors[v]) for v in y) for w in x) / (sum(map(idf, x)) or 1) if x and y else 0.0
        p, r = side(b, a or []), side(a or [], b)
        want = (p, r, 2 * p * r / (p + r) if p + r else 0.0)
        assert all(abs(x - y) < 2e-6 for x, y in zip(got[k], want)), k


# ---------------------------------------------------------------- quantised vectors


def test_quantised_search_on_clustered_and_repeated_vectors(spark, tmp_path):
    import numpy as np

    g = np.random.default_rng(3)
    x = g.normal(size=(1200, 32)) + 2 * np.eye(32)[g.integers(0, 6, 1200)]
    x[100:160] = x[100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0 and embedding is not null").selectExpr("vec_id as query_id", "embedding as q")
    books = pq.fit(vectors, slices=8)
    codes = pq.encode(vectors, books, f"file://{tmp_path}/codes")
    found, most = pq.search(queries, vectors, codes, books, 10)
    assert codes.count() == 1200 and most <= 120 and len(codes.first().code) == 8
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.score)
    x32 = x.astype(np.float32).astype(float)
    for q, s in got.items():
        best = np.sort(np.round(x32 @ x32[q], 6))[::-1][:10]
        assert sum(v >= best[-1] - 1e-6 for v in s) >= 9
