"""Registered queries over clinical messages made of the star schema (FHIR JSON and HL7 v2 texts), each with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, structured
from ..sources import loaders
from .catalogue import query, t

# Which fields a resource holds follows from its key, so that every branch of the parsers is met.


def _resources(spark, sf):
    """(json) of Patients (customer), MedicationRequests (orders), Observations (lineitem), Conditions (supplier), Procedures (part)."""
    iff = lambda c, x: F.when(F.expr(c), x)
    ref = lambda x: F.struct(F.concat(F.lit("Patient/p"), x.cast("string")).alias("reference"))
    lit = lambda x, n: F.lit(x).alias(n)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    c, o, li, s, p = (t(spark, sf, x) for x in ("customer", "orders", "lineitem", "supplier", "part"))
    patients = c.select(lit("Patient", "resourceType"), F.concat(F.lit("p"), "c_custkey").alias("id"), iff("c_custkey % 7 <> 0", F.array(F.struct(F.array(F.lit("Ann"), F.col("c_mktsegment")).alias("given"), F.col("c_name").alias("family")))).alias("name"), iff("c_custkey % 3 <> 0", F.concat(F.lit("19"), (F.col("c_custkey") % 90 + 10).cast("string"))).alias("birthDate"), iff("c_custkey % 2 = 0", F.lit("female")).alias("gender"), iff("c_custkey % 5 = 0", F.lit(False)).alias("active"))
    coded = F.struct(iff("o_orderkey % 3 = 0", F.col("o_orderpriority")).alias("text"), iff("o_orderkey % 3 = 1", F.array(F.struct(F.lit("sys").alias("system"), F.concat(F.lit("drug "), "o_orderpriority").alias("display")))).alias("coding"))
    dose = F.struct(F.lit("1 daily").alias("text"), F.struct(iff("o_orderkey % 4 = 0", F.lit("oral")).alias("text")).alias("route"), F.struct(F.struct(F.col("o_orderstatus").alias("text")).alias("code")).alias("timing"))
    orders = o.select(lit("MedicationRequest", "resourceType"), F.concat(F.lit("m"), "o_orderkey").alias("id"), iff("o_orderkey % 11 <> 0", ref(F.col("o_custkey"))).alias("subject"), coded.alias("medicationCodeableConcept"), F.col("o_orderstatus").alias("status"), day("o_orderdate").alias("authoredOn"), iff("o_orderkey % 2 = 0", F.array(dose)).alias("dosageInstruction"))
    items = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    observations = items.select(lit("Observation", "resourceType"), F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), ref(F.col("o_custkey")).alias("subject"), F.struct(F.concat(F.lit("test "), "l_returnflag").alias("text")).alias("code"), iff("l_linenumber % 3 <> 0", F.struct(F.col("l_quantity").alias("value"), F.lit("mg").alias("unit"))).alias("valueQuantity"), iff("l_linenumber % 3 = 0 and l_orderkey % 2 = 0", F.lit("negative")).alias("valueString"), F.lit("final").alias("status"), day("l_shipdate").alias("effectiveDateTime"), iff("l_linestatus = 'O'", F.array(F.struct(F.lit("high").alias("text")))).alias("interpretation"))
    icd = F.struct(F.lit("http://hl7.org/ICD-10").alias("system"), F.concat(F.lit("I"), "s_suppkey").alias("code"), F.lit(None).cast("string").alias("display"))
    other = F.struct(F.lit("http://snomed.info").alias("system"), F.lit("S1").alias("code"), F.col("s_name").alias("display"))
    conditions = s.select(lit("Condition", "resourceType"), F.concat(F.lit("c"), "s_suppkey").alias("id"), ref(F.col("s_suppkey")).alias("subject"), F.struct(F.when(F.expr("s_suppkey % 2 = 0"), F.array(other, icd)).otherwise(F.array(other)).alias("coding")).alias("code"), iff("s_suppkey % 3 = 0", F.struct(F.array(F.struct(F.lit("active").alias("code"))).alias("coding"))).alias("clinicalStatus"), iff("s_suppkey % 4 = 0", F.struct(F.lit("severe").alias("text"))).alias("severity"), iff("s_suppkey % 5 = 0", F.lit("2020-01-01")).alias("onsetDateTime"), lit("2021-01-01", "recordedDate"))
    procedures = p.select(lit("Procedure", "resourceType"), F.concat(F.lit("x"), "p_partkey").alias("id"), iff("p_partkey % 2 = 0", ref(F.col("p_size"))).alias("patient"), lit("2022-02-02", "date"))
    every = None
    for d in (patients, orders, observations, conditions, procedures):
        one = d.select(F.to_json(F.struct(*d.columns)).alias("json"))
        every = one if every is None else every.union(one)
    return every


_DAY = "strftime({}, '%Y-%m-%d')"
_QUANTITY = "CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(l_quantity AS VARCHAR) END"
_NAMES = "resource_type, resource_id, patient_id, date, name, status, gender, active, dosage, route, frequency, value, value_numeric, unit, interpretation, severity, icd10, raw_summary".split(", ")


def _kind_sql(source: str, **columns: str) -> str:
    return "SELECT " + ", ".join(f"{columns.get(n, 'NULL')} AS {n}" for n in _NAMES) + f" FROM {source}"


_FHIR = "f AS (" + " UNION ALL ".join([
    _kind_sql("customer", resource_type="'Patient'", resource_id="'p' || c_custkey", patient_id="'p' || c_custkey", date="CASE WHEN c_custkey % 3 <> 0 THEN '19' || (c_custkey % 90 + 10) END", name="CASE WHEN c_custkey % 7 <> 0 THEN 'Ann ' || c_mktsegment || ' ' || c_name ELSE '' END", gender="CASE WHEN c_custkey % 2 = 0 THEN 'female' END", active="c_custkey % 5 <> 0"),
    _kind_sql("orders", resource_type="'MedicationRequest'", resource_id="'m' || o_orderkey", patient_id="CASE WHEN o_orderkey % 11 <> 0 THEN 'p' || o_custkey ELSE '' END", date=_DAY.format("o_orderdate"), name="CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'drug ' || o_orderpriority ELSE 'unknown' END", status="o_orderstatus", dosage="CASE WHEN o_orderkey % 2 = 0 THEN '1 daily' END", route="CASE WHEN o_orderkey % 4 = 0 THEN 'oral' END", frequency="CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END"),
    _kind_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", resource_type="'Observation'", resource_id="'o' || l_orderkey || '-' || l_linenumber", patient_id="'p' || o_custkey", date=_DAY.format("l_shipdate"), name="'test ' || l_returnflag", status="'final'", value=f"CASE WHEN l_linenumber % 3 <> 0 THEN {_QUANTITY} WHEN l_orderkey % 2 = 0 THEN 'negative' ELSE '' END", value_numeric="CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END", unit="CASE WHEN l_linenumber % 3 <> 0 THEN 'mg' END", interpretation="CASE WHEN l_linestatus = 'O' THEN 'high' END"),
    _kind_sql("supplier", resource_type="'Condition'", resource_id="'c' || s_suppkey", patient_id="'p' || s_suppkey", date="CASE WHEN s_suppkey % 5 = 0 THEN '2020-01-01' ELSE '2021-01-01' END", name="s_name", status="CASE WHEN s_suppkey % 3 = 0 THEN 'active' ELSE 'unknown' END", severity="CASE WHEN s_suppkey % 4 = 0 THEN 'severe' END", icd10="CASE WHEN s_suppkey % 2 = 0 THEN 'I' || s_suppkey END"),
    _kind_sql("part", resource_type="'Procedure'", resource_id="'x' || p_partkey", patient_id="CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_size ELSE '' END", date="'2022-02-02'", raw_summary="""'{"resourceType":"Procedure","id":"x' || p_partkey || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"patient":{"reference":"Patient/p' || p_size || '"}' ELSE '' END || ',"date":"2022-02-02"}'"""),
]) + ")"


def _parsed(spark, sf, *kinds):
    return loaders.fhir_parsed(_resources(spark, sf), kinds=kinds)


@query(f"WITH {_FHIR} SELECT * FROM f")
def fhir_all_kinds(spark, sf):
    return _parsed(spark, sf)


@query(f"""WITH {_FHIR}, x AS (SELECT *, chr(10) AS nl FROM f)
SELECT resource_id, CASE resource_type WHEN 'Patient' THEN 'FHIR Patient:' || nl || rtrim('Name: ' || name) || nl || 'Birth Date: ' || coalesce(date, 'unknown')
 WHEN 'MedicationRequest' THEN 'FHIR MedicationRequest:' || nl || 'Medication: ' || CASE WHEN CAST(resource_id[2:] AS BIGINT) % 3 = 0 THEN name ELSE 'unknown' END || nl || 'Dosage: ' || coalesce(dosage, 'unknown')
 WHEN 'Observation' THEN 'FHIR Observation:' || nl || 'Observation: ' || name || nl || 'Value: ' || CASE WHEN unit IS NULL THEN '' ELSE value END || ' ' || coalesce(unit, '')
 WHEN 'Condition' THEN 'FHIR Condition:' || nl || 'Condition: unknown' || nl || 'Status: ' || status
 ELSE 'FHIR Procedure:' || nl || raw_summary END AS text FROM x""")
def fhir_to_text(spark, sf):
    return _resources(spark, sf).select(F.get_json_object("json", "$.id").alias("resource_id"), loaders.fhir_text(F.col("json")).alias("text"))


@query(f"WITH {_FHIR}, m AS (SELECT resource_id AS source_resource_id, patient_id, date, name, dosage, route, frequency FROM f WHERE resource_type = 'MedicationRequest') SELECT m.*, status, resource_type FROM m JOIN (SELECT resource_id AS source_resource_id, any_value(status) AS status, any_value(resource_type) AS resource_type FROM f WHERE resource_type = 'MedicationRequest' GROUP BY resource_id) USING (source_resource_id)")
def fhir_flatten_medications(spark, sf):
    p = _parsed(spark, sf, "MedicationRequest")
    m = structured.flatten(p, "MedicationRequest", "name", "dosage", "route", "frequency")
    return m.join(p.select(F.col("resource_id").alias("source_resource_id"), "status", "resource_type"), "source_resource_id", "left")


@query(f"WITH {_FHIR} SELECT resource_type, count(*) AS n, count(DISTINCT patient_id) AS patients, min(date) AS first_date FROM f WHERE resource_type IN ('Observation', 'Condition', 'Procedure') GROUP BY resource_type")
def fhir_flatten_counts(spark, sf):
    p = _parsed(spark, sf, "Observation", "Condition", "Procedure")
    return p.groupBy("resource_type").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.min("date").alias("first_date"))


@query(f"""WITH {_FHIR} SELECT resource_id, CASE WHEN CAST(resource_id[2:] AS BIGINT) % 2 = 0 THEN '{{"name":"' || name || '","status":"' || status || '"}}' ELSE name END AS body FROM f WHERE resource_type = 'MedicationRequest' AND status = 'F' AND date BETWEEN '1995-01-01' AND '1996-12-31'""")
def structured_projection(spark, sf):
    m = _parsed(spark, sf, "MedicationRequest").where("status = 'F' and date between '1995-01-01' and '1996-12-31'")
    even = F.substring("resource_id", 2, 20).cast("long") % 2 == 0
    return m.select("resource_id", F.when(even, F.to_json(F.struct("name", "status"))).otherwise(F.col("name")).alias("body"))


def _answer_sql(kind: str) -> str:
    what, none = structured.TEXTS[kind]
    names = "ns[:5]" if kind == "observations" else "ns"
    kinds = ", ".join(f"'{k}'" for k in structured.KINDS[kind])
    return f"""WITH {_FHIR}, g AS (SELECT patient_id, list(name ORDER BY resource_id, name) AS ns FROM f WHERE resource_type IN ({kinds}) GROUP BY patient_id)
SELECT p.resource_id AS patient_id, CAST(coalesce(len(ns), 0) AS INTEGER) AS total_count, CASE WHEN len(ns) > 0 THEN 'Found ' || len(ns) || ' {what}(s): ' || array_to_string({names}, ', ') ELSE '{none}' END AS answer_text FROM f p LEFT JOIN g ON g.patient_id = p.resource_id WHERE p.resource_type = 'Patient'"""


def _patients(spark, sf):
    return _parsed(spark, sf, "Patient").select("patient_id")


def _answered(spark, sf, kind):
    return structured.answers(_parsed(spark, sf, *structured.KINDS[kind]), _patients(spark, sf), kind)


@query(_answer_sql("medications"))
def answer_medications(spark, sf):
    return _answered(spark, sf, "medications")


@query(_answer_sql("observations"))
def answer_observations(spark, sf):
    return _answered(spark, sf, "observations")


@query(_answer_sql("conditions"))
def answer_conditions(spark, sf):
    return _answered(spark, sf, "conditions")


@query(f"""WITH {_FHIR}, g AS (SELECT patient_id, list(resource_id ORDER BY resource_id) AS ids FROM f GROUP BY patient_id)
SELECT p.resource_id AS patient_id, CAST(least(len(ids), 10) AS INTEGER) AS total_count, 'Found ' || least(len(ids), 10) || ' structured records.' AS answer_text, array_to_string(ids[:5], ',') AS first FROM f p JOIN g ON g.patient_id = p.resource_id WHERE p.resource_type = 'Patient'""")
def answer_all_kinds(spark, sf):
    return structured.any_records(_parsed(spark, sf), _patients(spark, sf))


@query(f"WITH {_FHIR} SELECT c.patient_id, c.resource_id AS condition_id, c.name AS condition, c.icd10, p.resource_id AS procedure_id, p.date AS performed FROM f c JOIN f p ON p.patient_id = c.patient_id WHERE c.resource_type = 'Condition' AND p.resource_type = 'Procedure' AND c.patient_id <> ''")
def conditions_with_procedures(spark, sf):
    return structured.conditions_with_procedures(_parsed(spark, sf, "Condition", "Procedure")).select("patient_id", "condition_id", "condition", "icd10", "procedure_id", "performed")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, '- ' || o_orderpriority || ', ' || o_orderstatus || ', since ' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders),
w AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - length(line) - 1 AS before FROM l)
SELECT o_custkey AS patient, CAST(before // 400 AS INTEGER) AS chunk_index, count(*) AS medications, sha256(string_agg(line, chr(10) ORDER BY o_orderkey)) AS list FROM w GROUP BY ALL""")
def medication_lists(spark, sf):
    """A patient's whole list of medications in one chunk, or in as many of 400 characters as it takes."""
    line = F.concat(F.lit("- "), "o_orderpriority", F.lit(", "), "o_orderstatus", F.lit(", since "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = t(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), "o_orderkey", line.alias("line"))
    return chunking.whole_lists(d, "patient", "o_orderkey", "line", 400).select("patient", "chunk_index", F.col("entries").alias("medications"), F.sha2("text", 256).alias("list"))


# ---------------------------------------------------------------- HL7: a message an order, a result segment a line item


def _messages(spark, sf):
    obx = F.concat(F.lit("OBX|"), "l_linenumber", F.lit("|NM|C"), F.col("l_partkey") % 10, F.lit("^Glucose^LN||"), F.col("l_quantity").cast("long"), F.lit("|mg|1-10|"), "l_returnflag", F.when(F.col("l_linenumber") % 2 == 0, "|||F").otherwise(""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", obx.alias("x")))), lambda x: x["x"]), "\n")
    items = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("obx"))
    o = t(spark, sf, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    kind = F.when(F.expr("o_orderkey % 4 = 0"), "ADT^A01").otherwise("ORU^R01")
    msh = F.concat(F.lit("MSH|^~\\&|LAB|p"), "o_custkey", F.lit("|||"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("||"), kind, F.when(F.expr("o_orderkey % 5 <> 0"), F.concat(F.lit("|"), "o_orderkey")).otherwise(""))
    pid = F.when(F.expr("o_orderkey % 6 <> 0"), F.concat(F.lit("PID|1||p"), "o_custkey", F.lit("||Doe^J"), F.when(F.expr("o_orderkey % 2 = 0"), "||19500101").otherwise("")))
    rxa = F.when(F.expr("o_orderkey % 3 = 0"), F.concat(F.lit("RXA|0|1|||"), "o_orderpriority", F.lit("|5|ml|||||IM")))
    return o.select(F.col("o_orderkey").alias("msg_id"), F.concat_ws("\r", msh, F.lit(" "), pid, "obx", rxa).alias("message"))


_KIND = "CASE WHEN o_orderkey % 4 = 0 THEN 'ADT^A01' ELSE 'ORU^R01' END"
_OBX = "'C' || (l_partkey % 10) || '^Glucose^LN'"


@query(f"""SELECT o_orderkey AS msg_id, CASE WHEN o_orderkey % 5 <> 0 THEN {_KIND} END AS message_type, CASE WHEN o_orderkey % 5 <> 0 THEN 'p' || o_custkey END AS patient_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'Doe^J' END AS patient_name,
 CASE WHEN o_orderkey % 6 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '19500101' ELSE '' END END AS birth_date, {_OBX} AS type, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, CASE WHEN l_orderkey IS NOT NULL THEN 'mg' END AS units FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def hl7_basic(spark, sf):
    return loaders.hl7_basic(_messages(spark, sf)).select("*", F.explode_outer("observations").alias("x")).select("msg_id", "message_type", "patient_id", "patient_name", "birth_date", "x.type", "x.value", "x.units")


_LINE = "'OBX|' || l_linenumber || '|NM|C' || (l_partkey % 10) || '^Glucose^LN||' || CAST(l_quantity AS BIGINT) || '|mg|1-10|' || l_returnflag || CASE WHEN l_linenumber % 2 = 0 THEN '|||F' ELSE '' END"
_LAST = f"l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, {_LINE} DESC) = 1)"


@query(f"""WITH {_LAST} SELECT o_orderkey AS msg_id, {_KIND} AS message_type, strftime(o_orderdate, '%Y%m%d') AS date, CASE WHEN o_orderkey % 6 <> 0 THEN 'p' || o_custkey END AS patient_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'Doe^J' END AS patient_name,
 CAST(l_linenumber AS VARCHAR) AS set_id, {_OBX} AS type, CASE WHEN l_orderkey IS NOT NULL THEN '1-10' END AS reference_range, l_returnflag AS abnormal_flag, CASE WHEN l_linenumber % 2 = 0 THEN 'F' WHEN l_linenumber IS NOT NULL THEN '' END AS obx_status,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS medication, CASE WHEN o_orderkey % 3 = 0 THEN 'IM' END AS route FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def hl7_full(spark, sf):
    f = loaders.hl7_full(_messages(spark, sf)).withColumns({"o": F.get("observations", 0), "m": F.get("medications", 0)})
    return f.select("msg_id", "message_type", "date", "patient_id", "patient_name", "o.set_id", "o.type", "o.reference_range", "o.abnormal_flag", F.col("o.status").alias("obx_status"), "m.medication", "m.route")


@query(f"""SELECT 'Observation' AS resource_type, o_orderkey || '-' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, {_LINE}) AS resource_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'p' || o_custkey END AS patient_id, 'C' || (l_partkey % 10) AS code, 'Glucose' AS display, 'LN' AS system, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'Encounter', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 6 <> 0 THEN 'p' || o_custkey END, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0""")
def hl7_to_fhir(spark, sf):
    return loaders.hl7_to_fhir(loaders.hl7_full(_messages(spark, sf), keep_all=True))


@query(f"""WITH {_FHIR} SELECT resource_id AS id, name, value, unit, NULL AS set_id FROM f WHERE resource_type = 'Observation' UNION ALL SELECT CAST(o_orderkey AS VARCHAR), {_OBX}, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 'mg', CAST(l_linenumber AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def observations_union(spark, sf):
    f = _parsed(spark, sf, "Observation").select(F.col("resource_id").alias("id"), "name", "value", "unit")
    h = loaders.hl7_full(_messages(spark, sf), keep_all=True).select(F.col("msg_id").cast("string").alias("id"), F.explode_outer("observations").alias("o")).where("o is not null").select("id", F.col("o.type").alias("name"), "o.value", F.col("o.units").alias("unit"), "o.set_id")
    return f.unionByName(h, allowMissingColumns=True)
