"""Odd inputs of the operators: nulls, blank and long texts, broken files, failing models, streams that append."""

import struct

from pyspark.sql import functions as F

from tesselon.functions import rules
from tesselon.operators import answers, chunking, index, intent, models, pii, retrieval, service
from tesselon.sources import loaders
from tesselon.streaming import streams


def test_chunkers_of_odd_texts(spark):
    long = "word " * 9000
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "MEDICATIONS:\naspirin 81 mg daily in the morning, with some food and water please, always\n\nChief Complaint: pain"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.chunk_documents(docs, rules.HEADERS, 800, 1600, 1400, 5).collect()
    assert {r.doc_id for r in got} == {4, 5} and [r.section for r in got if r.doc_id == 4] == ["MEDICATIONS"]
    windows = [r for r in got if r.doc_id == 5]
    assert len(windows) == 7 and [r.overlap_prev for r in windows] == [False] + [True] * 6 and [r.overlap_next for r in windows] == [True] * 6 + [False]
    again = chunking.chunk_for_evaluation(docs, rules.EVALUATION_HEADERS).collect()
    assert all(r.text.split("\n")[0].split() == ["word"] * 50 for r in again if r.doc_id == 5 and r.overlap_prev)
    assert chunking.chunk_documents(docs.where("false"), rules.HEADERS).count() == 0


def test_first_of_overlapping_entities_wins():
    find = pii.Detector()
    text = "DOB: 01/02/1960 Patient: Ann Lee, call (555) 123-4567 or 123-45-6789"
    found = find(text)
    assert [k for k, *_ in found] == ["dob", "person_name", "phone", "ssn"]
    assert pii.masked(text, found).startswith("[DOB_REDACTED] Patient: [PERSON_") and find(None) == [] and pii.masked(None, []) is None
    assert find("MRN 123456")[0][3] == find("x MRN 123456")[0][3] != pii.Detector("other")("MRN 123456")[0][3]


def test_broken_messages(spark):
    r = spark.createDataFrame([("{broken",), ("{}",), ('{"resourceType":"Patient","id":"1"}',), (None,)], "json string")
    assert [x.resource_type for x in loaders.fhir_parsed(r).collect()] == [None, None, "Patient", None]
    m = spark.createDataFrame([(1, "MSH|a"), (2, ""), (3, None), (4, "OBX|1||C||5\r\nOBX|2||D||6\nPID|1")], "msg_id int, message string")
    full = {x.msg_id: x for x in loaders.hl7_full(m).collect()}
    assert full[1].message_type == "" and full[4].observations[0]["value"] == "6" and len(full[4].observations) == 1
    assert [len(x.observations) for x in loaders.hl7_full(m.where("msg_id = 4"), keep_all=True).collect()] == [2]
    assert {x.msg_id: x.patient_name for x in loaders.hl7_basic(m).collect()}[4] == ""


def test_binary_files(spark, tmp_path):
    field = lambda g, e, k, v: struct.pack("<HH", g, e) + k + struct.pack("<H", len(v)) + v
    (tmp_path / "a.dcm").write_bytes(bytes(128) + b"DICM" + field(8, 0x60, b"CS", b"CT") + field(0x10, 0x20, b"LO", b"p1 "))
    (tmp_path / "b.dcm").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {r.path[-5:]: r for r in loaders.binary_files(spark, str(tmp_path)).collect()}
    assert got["a.dcm"].header == {"modality": "CT", "patient_id": "p1"} and got["b.dcm"].load_error and (got["c.pdf"].text_content or got["c.pdf"].load_error)


def test_models_are_injected_and_asked_again(spark):
    def make():
        tries = {}

        def client(message):
            tries[message] = tries.get(message, 0) + 1
            if message == "never" or tries[message] < 2:
                raise RuntimeError("busy")
            return "answer to " + message

        return client

    p = spark.createDataFrame([(1, "later"), (2, "never")], "query_id int, user_message string")
    got = {r.query_id: r.answer for r in models.generate(p, make, wait=0.0).collect()}
    assert got == {1: "answer to later", 2: "[LLM Error: busy]"}
    docs = spark.createDataFrame([(1, "aa"), (2, "b")], "doc_id long, text string")
    assert [r.vector for r in models.encode(docs, lambda: lambda ts: [[float(len(t))] for t in ts]).orderBy("doc_id").collect()] == [[2.0], [1.0]]
    pairs = spark.createDataFrame([(1, 1, "q", "long text", 0.1), (1, 2, "q", "t", 0.9)], "query_id int, doc_id int, question string, text string, score double")
    scored = models.cross_encode(pairs, lambda: lambda qs, ts: [float(len(t)) for t in ts])
    assert [r.doc_id for r in retrieval.rerank(scored, 1).collect()] == [1] and [r.doc_id for r in retrieval.rerank(scored, 1, 100.0).collect()] == [2]


def test_search_of_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta beta"), (4, "alpha " * 20000), (5, "gamma delta epsilon")], "doc_id long, text string")
    path = index.build(docs, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(1, "beta"), (1, "beta"), (2, "absent")], "query_id int, term string")
    once = index.search(spark, path, asked.distinct()).collect()
    twice = index.search(spark, path, asked).collect()
    assert [(r.query_id, r.doc_id) for r in twice] == [(1, 3)] and abs(twice[0].score - 2 * once[0].score) < 1e-5
    index.append(spark.createDataFrame([(9, "beta")], "doc_id long, text string"), path)
    assert {r.doc_id for r in index.search(spark, path, asked).collect()} == {3, 9}


def test_expansion_is_case_insensitive_and_limited(spark):
    d = spark.createDataFrame([("ECG and EKG of diabetes, hypertension, lab, allergy, surgery",), ("hello",), (None,)], "q string")
    got = [r[0] for r in d.select(intent.expansion_terms(F.col("q"))).collect()]
    assert len(got[0]) == 10 and len({x.term.lower() for x in got[0]}) == 10 and [x.kind for x in got[1]] == ["original"]


def test_prompts_without_context(spark):
    q = spark.createDataFrame([(1, "what?", None), (2, None, "p")], "query_id int, question string, patient_id string")
    c = spark.createDataFrame([(1, 0, "x" * 400, None, None, 0.5), (1, 1, "y" * 400, None, None, 0.25)], "query_id int, rank int, text string, kind string, section string, score double")
    got = {r.query_id: r for r in answers.prompts(q, c, 150).collect()}
    assert got[1].n_context == 1 and got[1].tokens == 101 and "[document | general | score: 0.50]" in got[1].user_message
    assert answers.NO_CONTEXT in got[2].user_message and got[2].user_message.startswith("Patient ID: p\n\n") and got[2].n_context == 0


def test_cache_hits_and_clearing(spark):
    c = spark.createDataFrame([(1, "p1", 0), (2, "p2", 5)], "entry_id int, patient_id string, hit_count int")
    look = spark.createDataFrame([(1,), (1,)], "entry_id int")
    assert {r.entry_id: r.hit_count for r in service.hits(look, c).collect()} == {1: 2, 2: 5}
    assert service.cleared(c, spark.createDataFrame([("p2",), ("p2",)], "patient_id string")).collect()[0].entries_cleared == 1


def test_audit_stream_appends(spark, tmp_path):
    schema = "event_id long, kind string"
    for n in range(2):
        spark.createDataFrame([(n, "query")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        run = streams.audit_sink(streams.event_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/state")
        run.processAllAvailable()
        run.stop()
    assert sorted(r.event_id for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect()) == [0, 1]


def test_approximate_search_finds_nine_of_ten(spark):
    from tesselon.plans import catalogue, search

    for sf in ("sf0.01", "sf0.1"):
        path = f"/root/testdata/{sf}"
        exact = {(r.query_id, r.vec_id) for r in catalogue.queries()["dense_topk_batch_all"](spark, path).collect()}
        found = {(r.query_id, r.vec_id) for r in search.ivf_search(spark, path).collect()}
        assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
