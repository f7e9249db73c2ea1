"""Three questions a patient, from ingestion to answer: python examples/demo.py"""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tesselon.functions import rules
from tesselon.operators import answers, chunking, index, intent, pii, retrieval
from tesselon.session import session, shared_folder, ship

NOTES = [
    ("A1", "DISCHARGE SUMMARY\nPatient: Ann Lee, DOB: 01/02/1950\n\nMEDICATIONS:\naspirin 81 mg daily and lisinopril 10 mg daily for hypertension\n\nASSESSMENT:\nstable after myocardial infarction, follow up in two weeks"),
    ("B1", "LAB RESULTS:\nglucose 180 mg/dL, HbA1c 8.1 percent, reported to (555) 123-4567\n\nPLAN:\nstart metformin for diabetes and repeat the tests in three months"),
]
ASKED = ["What medications is the patient on?", "Why was aspirin started?", "Summarize the diabetes care"]


def main() -> None:
    spark = session("demo", 2, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    notes = pii.detect(spark.createDataFrame(NOTES, "doc_id string, text string"))
    chunks = chunking.chunk_documents(notes.select("doc_id", "text"), rules.HEADERS, least_tokens=5).withColumn("doc_id", F.concat_ws("_", "doc_id", "chunk_index"))
    path = index.build(chunks, f"{shared_folder(spark)}-index")
    asked = spark.createDataFrame([(f"{p}{n}", p, q) for p in "AB" for n, q in enumerate(ASKED)], "query_id string, patient_id string, question string")
    asked = asked.withColumn("wide", intent.expanded_query(F.col("question"), intent.expansion_terms(F.col("question"))))
    terms = asked.select("query_id", "patient_id", F.explode(F.regexp_extract_all(F.lower("wide"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("term"))
    mine = index.search(spark, path, terms.drop("patient_id")).join(asked.select("query_id", "patient_id"), "query_id").where(F.col("doc_id").startswith(F.col("patient_id")))
    found = retrieval.top_k(mine, "query_id", 5, F.desc("score"), F.col("doc_id")).join(chunks.select("doc_id", "text", "section"), "doc_id")
    context = found.select("query_id", "rank", "text", F.lit("note").alias("kind"), "section", "score")
    done = answers.prompts(asked, context).select("query_id", answers.template_answer(F.col("user_message"))["answer"].alias("answer"))
    for r in asked.join(done, "query_id").orderBy("query_id").collect():
        print(f"\n[{r.patient_id}] {r.question}\n{r.answer}")
    spark.stop()


if __name__ == "__main__":
    main()
