"""Steps whose work or memory must not grow faster than their input."""

import duckdb
from pyspark.sql import functions as F

from tesselon.functions import rules
from tesselon.operators import answers, chunking, pii
from tesselon.plans import messages, notes
from tesselon.sources import loaders


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_passes_once_a_rule(spark):
    """Nested expressions held the first rules eight times, and took a letter outside ASCII for part of a word, as the SQL does not."""
    texts = ["é123-45-6789", "äMRN: 123456 ö", None, "", "MRN: 123456 mrn 123456, Serial No: ABC-123456, Dr. Jo Ann Ray (555) 123-4567 a@b.org", "Pt. Ann Lee seen 1/2/2020, DOB: 1/2/1960"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = d.select("doc_id", pii.clean(F.col("text")).alias("text"))
    assert all(plan(out).count(p) <= 1 for _, p in rules.rows(rules.EVALUATION_PII))
    con = duckdb.connect()
    con.execute("create table planted (doc_id int, text varchar)")
    con.executemany("insert into planted values (?, ?)", list(enumerate(texts)))
    want = dict(con.sql(f"WITH {notes._clean_sql()} SELECT doc_id, text FROM c10").fetchall())
    assert {r.doc_id: r.text for r in out.collect()} == want and want[0] == "é[SSN_REDACTED]"


def test_resources_are_parsed_once(spark):
    """A filter on parsed columns held the parser up to seven times more, and each use of a kind parsed all kinds."""
    d = "/root/testdata/sf0.001"
    assert plan(messages.observations_union(spark, d)).count("from_json") == 1 and plan(messages.answer_observations(spark, d)).count("from_json") == 2
    assert plan(messages.conditions_with_procedures(spark, d)).count("from_json") == 2 and plan(messages.observations_union(spark, d)).count("split(") == 2


def test_kinds_of_odd_resources(spark):
    texts = ['{"resourceType":"Patient","id":"1"}', "{'resourceType':'Patient','id':'2'}", '{"resourceType":"\\u0050atient","id":"3"}', '{"resourceType":"Observation","subject":{"reference":"Patient/1"}}', '{"resourceType":"Observation","id":"Patient"}', '{"id":"Patient"}', "{broken", None]
    r = spark.createDataFrame([(x,) for x in texts], "json string")
    every = [x for x in loaders.fhir_parsed(r).collect()]
    assert len(every) == len(texts)
    assert loaders.fhir_parsed(r, kinds=("Patient",)).collect() == [x for x in every if x.resource_type == "Patient"] and [x.resource_id for x in loaders.fhir_parsed(r, kinds=("Patient",)).collect()] == ["1", "2", "3"]


def test_chunks_leave_python_in_bounded_batches(spark):
    """The chunks of a whole batch of documents lay in Python as objects before they were sent."""
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4000))
    d = spark.createDataFrame([(i, text if i != 2 else None) for i in range(4)], "doc_id long, text string").coalesce(1)
    assert len(text) > chunking.BATCH_CHARS
    for out in (chunking.chunk_documents(d, rules.HEADERS, 150, 160, 140, 20), chunking.chunk_for_evaluation(d, rules.EVALUATION_HEADERS, 150, 90, 60, 15, 50)):
        assert "MapInArrow" in plan(out) and "ArrowEvalPython" not in plan(out)
        got = {i: sorted((r.chunk_index, r.text, r.overlap_prev) for r in out.where(F.col("doc_id") == i).collect()) for i in range(4)}
        assert not got[2] and got[0] == got[1] == got[3] and [k for k, *_ in got[0]] == list(range(len(got[0])))
        assert all(any(f"w{i}x59" in t for _, t, _ in got[0]) for i in range(0, 4000, 500))


def test_passes_of_the_feedback_loop_stand_alone(spark):
    """One task held the sorts and joins of all passes."""
    scores = spark.createDataFrame([(1, 0.9, 0.9, 0.9), (2, 0.6, 0.8, 0.8), (3, 0.1, 0.2, 0.3)], "query_id int, a double, b double, c double")
    calls = []

    def attempt(open_):
        calls.append(1)
        return open_.join(scores, "query_id").withColumn("score", F.col("abc"[len(calls) - 1])).withColumn("answer", F.col("question")).drop("a", "b", "c")

    ask = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "query_id int, question string")
    out = answers.feedback_loop(ask, attempt, 1)
    assert "Join" not in plan(out)
    assert sorted((r.query_id, r.answer, r.score, r.attempts) for r in out.collect()) == [(1, "one", 0.9, 0), (2, "two related information", 0.8, 1), (3, "three", 0.3, 2)]
    calls.clear()
    assert [r.attempts for r in answers.feedback_loop(ask.where("query_id = 1"), attempt, 1).collect()] == [0]
    calls.clear()
    assert answers.feedback_loop(ask.where("false"), attempt, 1).count() == 0
