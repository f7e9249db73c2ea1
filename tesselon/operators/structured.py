"""Questions answered from parsed resources: kind filters, projections and answer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

KINDS = {"medications": ("MedicationRequest", "MedicationAdministration"), "observations": ("Observation",), "conditions": ("Condition",)}
TEXTS = rules.ANSWER_TEXTS
NAMED, LISTED = 5, 10


def answer_text(kind: str, names: Column) -> Column:
    """Found n kind(s): the names, of observations the first five; or the sentence for none."""
    what, none = TEXTS[kind]
    listed = F.slice(names, 1, NAMED) if kind == "observations" else names
    found = F.concat(F.lit("Found "), F.size(names).cast("string"), F.lit(f" {what}(s): "), F.array_join(listed, ", "))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, found).otherwise(none)


def answers(parsed: DataFrame, patients: DataFrame, kind: str) -> DataFrame:
    """patient_id, total_count, answer_text for every patient, in the order of resource ids."""
    named = parsed.where(F.col("resource_type").isin(*KINDS[kind])).groupBy("patient_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("resource_id", "name"))), lambda x: x["name"]).alias("names"))
    return patients.join(named, "patient_id", "left").select("patient_id", F.coalesce(F.size("names"), F.lit(0)).alias("total_count"), answer_text(kind, F.col("names")).alias("answer_text"))


def any_records(parsed: DataFrame, patients: DataFrame) -> DataFrame:
    """patient_id, total_count, answer_text, first: the first ten records of any kind, counted after the limit, five of them shown."""
    ids = parsed.groupBy("patient_id").agg(F.array_sort(F.collect_list("resource_id")).alias("ids"))
    n = F.least(F.coalesce(F.size("ids"), F.lit(0)), F.lit(LISTED))
    return patients.join(ids, "patient_id", "left").select("patient_id", n.alias("total_count"), F.concat(F.lit("Found "), n.cast("string"), F.lit(" structured records.")).alias("answer_text"), F.coalesce(F.array_join(F.slice("ids", 1, NAMED), ","), F.lit("")).alias("first"))


def flatten(parsed: DataFrame, kind: str, *columns: str) -> DataFrame:
    """A table of one kind of resource with the id of its source."""
    return parsed.where(F.col("resource_type") == kind).select(F.col("resource_id").alias("source_resource_id"), "patient_id", "date", *columns)


def conditions_with_procedures(parsed: DataFrame) -> DataFrame:
    """Each condition with each procedure of its patient; resources without a patient have no partner."""
    known = parsed.where("patient_id <> ''")
    c = known.where("resource_type = 'Condition'").select("patient_id", F.col("resource_id").alias("condition_id"), F.col("name").alias("condition"), "icd10", "status", "severity", F.col("date").alias("onset"))
    p = known.where("resource_type = 'Procedure'").select("patient_id", F.col("resource_id").alias("procedure_id"), F.col("date").alias("performed"), "raw_summary")
    return c.join(p, "patient_id")
