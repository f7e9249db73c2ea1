"""Literal cases of operators that the tables hold no instance of."""

import hashlib
import re

from pyspark.sql import functions as F

from tesselon.functions import text
from tesselon.operators import answers, chunking
from tesselon.sources import loaders
from tesselon.streaming import streams


def test_pii_types(spark):
    rows = ["SSN 123-45-6789", "call (555) 123-4567", "MRN: 1234567", "DOB: 01/02/1960", "on March 3, 2020", "92 years old", "Dr. Ann Lee saw", "nothing 12-34", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.pii_types(F.col("t"))).collect()]
    assert got == [["ssn"], ["phone"], ["mrn"], ["date_numeric", "dob"], ["specific_date"], ["age_over_89"], ["person_name"], [], [], []]


def test_packing_overlap(spark):
    t = "\n\n".join(["a" * 40, "b" * 40, "c" * 40])
    got = spark.createDataFrame([(t,)], "t string").select(chunking.pack_paragraphs(F.col("t"), 20)).first()[0]
    assert got == ["a" * 40 + "\n\n" + "b" * 40, "b" * 40 + "\n\n" + "c" * 40]


def test_confidence_levels(spark):
    d = spark.createDataFrame([(1.0, 5, "word " * 30), (0.2, 1, "short"), (1.0, 5, "Not found")], "s double, n int, a string")
    got = [tuple(r) for r in d.select(answers.confidence(F.col("s"), F.col("n"), F.col("a")).alias("c")).select("c", answers.level(F.col("c"))).collect()]
    assert got == [(1.0, "high"), (0.195, "low"), (0.3, "low")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Discharge summary of a patient")
    (tmp_path / "b.xyz").write_text("?")
    got = {r.path[-5:]: r for r in loaders.text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].content_type == "discharge_summary" and got["a.txt"].load_error is None
    assert got["b.xyz"].load_error


def test_stream_metrics_equal_batch(spark):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = streams.tumbling_metrics(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    run.processAllAvailable()
    run.stop()
    batch = streams.tumbling_metrics(spark.read.parquet(f"{path}/events.parquet"))
    assert spark.table("hourly").exceptAll(batch).count() == 0 == batch.exceptAll(spark.table("hourly")).count()


def test_dense_search_takes_every_twentieth_row(spark, tmp_path, monkeypatch):
    from tesselon.operators import retrieval
    from tesselon.plans import catalogue

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "VECTOR_SLICE", 3)
    rows = [(i, [float(i), 1.0], i % 2) for i in range(101)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.queries()["dense_topk_batch_all"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in found} == {0, 20, 40, 60, 80, 100} and len(found) == 60
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 20] == list(range(100, 90, -1))
    quality = {r.query_id: r for r in catalogue.queries()["retrieval_quality_all"](spark, str(tmp_path)).collect()}
    assert len(quality) == 6 and quality[100].mrr == 0.5 and quality[20].precision_at_10 == 0.5


def test_every_user_turn_is_asked(spark, tmp_path):
    from tesselon.plans import catalogue

    rows = [(1, 0, "user", "Is there an ECG or EKG of last week?"), (1, 1, "assistant", "why"), (2, 0, "user", None), (2, 2, "user", "list the labs " * 3000), (2, 2, "user", "why")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: sorted(tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
    assert run("classify_queries_all") == [(1, 0, "temporal", 0.65), (2, 0, "factual_lookup", 0.4), (2, 2, "explanation", 0.65), (2, 2, "structured_query", 0.65)]
    assert [r[3] for r in run("route_queries_all")] == ["hybrid_retrieval", "hybrid_retrieval", "hybrid_retrieval", "structured_query"]
    assert run("expand_queries_all") == [(1, 0, "electrocardiogram"), (2, 0, ""), (2, 2, ""), (2, 2, "")]
    assert [r[3] for r in catalogue.queries()["cache_key_and_structured_route_all"](spark, str(tmp_path)).orderBy("conv_id", "turn", "kind").collect()] == ["all", "all", "all", "observations"]


def packed(t, most, size, step):
    """The packing as plain Python."""
    paras = [p.strip() for p in re.split(r"\n\s*\n", t or "") if p.strip()]
    tokens = lambda x: max(1, len(x) // 4)

    def windows(p):
        w = p.split()
        return [p] if len(w) <= size else [" ".join(w[i : i + size]) for i in range(0, len(w) - size + step, step)]

    if len(paras) == 1:
        return windows(paras[0])
    out, now, n = [], [], 0
    for p in paras:
        if tokens(p) > most:
            out += ["\n\n".join(now)] * bool(now) + windows(p)
            now, n = [], 0
        elif now and n + tokens(p) > most:
            out.append("\n\n".join(now))
            now = [now[-1], p]
            n = tokens("\n\n".join(now))
        else:
            now, n = [*now, p], n + tokens(p)
    return out + ["\n\n".join(now)] * bool(now)


def test_oversize_paragraphs_go_in_windows(spark):
    big = " ".join(f"w{i}" for i in range(50))
    texts = [big, f"one\n\n{big}\n\ntwo\n\nthree", "a" * 200 + "\n\nb", "", "x\n\ny", "\n\n".join("abcd" * 4 for _ in range(9))]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", chunking.pack_paragraphs(F.col("t"), 12, 20, 15).alias("c"))
    got = {r.i: r.c for r in d.collect()}
    assert got == {i: packed(x, 12, 20, 15) for i, x in enumerate(texts)} and len(got[0]) == 3


def test_every_document_is_chunked(spark):
    from tesselon.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in catalogue.queries()["paragraph_pack_all"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.hash)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: [hashlib.sha256(c.encode()).hexdigest() for c in packed(r.text, 800, 1600, 1400)] for r in docs}
    assert got == {k: v for k, v in want.items() if v}


def test_hash_vector_of_each_document(spark):
    from tesselon.operators import retrieval

    rows = [(1, "a a a a"), (2, ""), (3, None), (4, "A a b")]
    got = {r.doc_id: r.vector for r in retrieval.hash_vectors(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()}
    assert sorted(got[1])[-2:] == [0.0, 1.0] and got[2] == got[3] == [0.0] * 64
    assert sorted(got[4])[-2:] == [0.447214, 0.894427]
