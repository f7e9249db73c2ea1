"""Files and message formats as DataFrames: text, FHIR JSON, HL7 v2; parquet and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clinical_type
from . import dicom


def document_id(path: Column) -> Column:
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; files of unknown kinds stay as rows with load_error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.decode("content", "UTF-8")
    known = kind.isin("txt", "rtf", "hl7", "json")
    return files.select(document_id(F.col("path")).alias("document_id"), "path", F.col("length").alias("file_size"), F.when(known, text).alias("text_content"), F.when(kind == "hl7", "hl7_message").when(kind == "json", "fhir_resource").when(known, clinical_type(text)).alias("content_type"), kind.isin("hl7", "json").alias("requires_structured_path"), F.when(~known, F.concat(F.lit("Unsupported file type: ."), kind)).alias("load_error"))


FHIR = "resourceType string, id string, status string, authoredOn string, effectiveDateTime string, onsetDateTime string, recordedDate string, birthDate string, gender string, active boolean, name array<struct<given:array<string>,family:string>>, subject struct<reference:string>, code struct<text:string,coding:array<struct<system:string,code:string,display:string>>>, medicationCodeableConcept struct<text:string,coding:array<struct<system:string,code:string,display:string>>>, dosageInstruction array<struct<text:string,route:struct<text:string>>>, valueQuantity struct<value:double,unit:string>, valueString string, clinicalStatus struct<coding:array<struct<code:string>>>"


def _named(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"{c}.text"), F.lit("")), F.get(F.col(f"{c}.coding"), 0)["display"], F.lit("unknown"))


def _once(x: Column) -> Column:
    """``x`` as a row of its own: a filter on what is made of it stays behind it, where else ``x`` would be made for each filter and once more."""
    return F.explode(F.array(x))


def fhir(resources: DataFrame, column: str = "json") -> DataFrame:
    """resource_type, resource_id, patient_id, name, value, unit, status, date for the four main kinds of resource."""
    r = resources.select(_once(F.from_json(column, FHIR)).alias("r")).select("r.*")
    kind = F.col("resourceType")
    person = F.concat_ws(" ", F.concat_ws(" ", F.get("name", 0)["given"]), F.get("name", 0)["family"])
    icd = F.get(F.filter("code.coding", lambda c: F.lower(c["system"]).contains("icd")), 0)["code"]
    return r.select(
        kind.alias("resource_type"),
        F.col("id").alias("resource_id"),
        F.when(kind == "Patient", F.col("id")).otherwise(F.replace(F.col("subject.reference"), F.lit("Patient/"), F.lit(""))).alias("patient_id"),
        F.when(kind == "Patient", person).when(kind == "MedicationRequest", _named("medicationCodeableConcept")).otherwise(_named("code")).alias("name"),
        F.when(kind == "Observation", F.coalesce(F.col("valueQuantity.value").cast("string"), F.col("valueString"))).when(kind == "Condition", icd).when(kind == "MedicationRequest", F.get("dosageInstruction", 0)["text"]).alias("value"),
        F.col("valueQuantity.unit").alias("unit"),
        F.when(kind == "Condition", F.coalesce(F.get("clinicalStatus.coding", 0)["code"], F.lit("unknown"))).otherwise(F.col("status")).alias("status"),
        F.coalesce("authoredOn", "effectiveDateTime", "onsetDateTime", "recordedDate", "birthDate").alias("date"),
    )


def hl7_observations(messages: DataFrame, column: str = "message", keep_all: bool = True) -> DataFrame:
    """msg_id, set_id, code, value, units of the OBX segments; ``keep_all=False`` keeps only the last one."""
    seg = messages.select("msg_id", F.posexplode(F.split(column, r"\r\n|[\n\r]")).alias("pos", "line")).select("msg_id", "pos", F.split("line", r"\|").alias("f")).where(F.get("f", 0) == "OBX")
    if not keep_all:
        seg = seg.groupBy("msg_id").agg(F.max_by("f", "pos").alias("f"))
    return seg.select("msg_id", F.get("f", 1).alias("set_id"), F.get("f", 3).alias("code"), F.get("f", 5).alias("value"), F.get("f", 6).alias("units"))


_CODED = "struct<text:string,coding:array<struct<system:string,code:string,display:string>>>"
_REF = "struct<reference:string>"
FHIR_ALL = f"resourceType string, id string, status string, date string, authoredOn string, effectiveDateTime string, onsetDateTime string, recordedDate string, birthDate string, gender string, active boolean, name array<struct<given:array<string>,family:string>>, subject {_REF}, patient {_REF}, code {_CODED}, medicationCodeableConcept {_CODED}, dosageInstruction array<struct<text:string,route:struct<text:string>,timing:struct<code:struct<text:string>>>>, valueQuantity struct<value:double,unit:string>, valueString string, interpretation array<struct<text:string>>, severity struct<text:string>, clinicalStatus struct<coding:array<struct<code:string>>>"
KINDS = ("Patient", "MedicationRequest", "Observation", "Condition")


def _person() -> Column:
    given = F.coalesce(F.concat_ws(" ", F.get("r.name", 0)["given"]), F.lit(""))
    return F.trim(F.concat(given, F.lit(" "), F.coalesce(F.get("r.name", 0)["family"], F.lit(""))))


def _may_be(json: Column, kinds: tuple[str, ...]) -> Column:
    """Whether a text can be a resource of these kinds: it holds a kind's name in quotes, or an escape that may spell it."""
    may = json.contains("\\")
    for k in kinds:
        may = may | json.contains(f'"{k}"') | json.contains(f"'{k}'")
    return may


def fhir_parsed(resources: DataFrame, column: str = "json", kinds: tuple[str, ...] = ()) -> DataFrame:
    """resource_type, resource_id, patient_id, date, and the fields of each kind of resource; raw_summary for any other kind.

    Broken JSON gives a row of nulls.  ``value`` is text, ``value_numeric`` the number where there is one.  With ``kinds``,
    the rows of these kinds only; texts that can't be one aren't parsed.
    """
    json = F.from_json(column, FHIR_ALL)
    made = F.explode(F.when(_may_be(F.col(column), kinds), F.array(json))) if kinds else _once(json)
    r = resources.select(F.col(column).alias("raw"), made.alias("r"))
    r = r.where(F.col("r.resourceType").isin(*kinds)) if kinds else r
    kind, of = F.col("r.resourceType"), lambda k: F.col("r.resourceType") == k
    patient = lambda c: F.replace(F.col(f"r.{c}.reference"), F.lit("Patient/"), F.lit(""))
    named = lambda c: _named(f"r.{c}")
    dose = F.get("r.dosageInstruction", 0)
    quantity = F.col("r.valueQuantity.value")
    return r.select(
        kind.alias("resource_type"),
        F.col("r.id").alias("resource_id"),
        F.when(of("Patient"), F.col("r.id")).when(kind.isin(*KINDS), F.coalesce(patient("subject"), F.lit(""))).otherwise(F.coalesce(patient("subject"), patient("patient"), F.lit(""))).alias("patient_id"),
        F.when(of("Patient"), F.col("r.birthDate")).when(of("MedicationRequest"), F.col("r.authoredOn")).when(of("Observation"), F.col("r.effectiveDateTime")).when(of("Condition"), F.coalesce("r.onsetDateTime", "r.recordedDate")).otherwise(F.coalesce("r.date", "r.effectiveDateTime", "r.authoredOn")).alias("date"),
        F.when(of("Patient"), _person()).when(of("MedicationRequest"), named("medicationCodeableConcept")).when(kind.isin("Observation", "Condition"), named("code")).alias("name"),
        F.when(of("Condition"), F.coalesce(F.get("r.clinicalStatus.coding", 0)["code"], F.lit("unknown"))).when(kind.isin("MedicationRequest", "Observation"), F.col("r.status")).alias("status"),
        F.when(of("Patient"), F.col("r.gender")).alias("gender"),
        F.when(of("Patient"), F.coalesce("r.active", F.lit(True))).alias("active"),
        F.when(of("MedicationRequest"), dose["text"]).alias("dosage"),
        F.when(of("MedicationRequest"), dose["route"]["text"]).alias("route"),
        F.when(of("MedicationRequest"), dose["timing"]["code"]["text"]).alias("frequency"),
        F.when(of("Observation"), F.coalesce(quantity.cast("string"), "r.valueString", F.lit(""))).alias("value"),
        F.when(of("Observation"), quantity).alias("value_numeric"),
        F.when(of("Observation"), F.col("r.valueQuantity.unit")).alias("unit"),
        F.when(of("Observation"), F.get("r.interpretation", 0)["text"]).alias("interpretation"),
        F.when(of("Condition"), F.col("r.severity.text")).alias("severity"),
        F.when(of("Condition"), F.get(F.filter("r.code.coding", lambda c: F.lower(c["system"]).contains("icd")), 0)["code"]).alias("icd10"),
        F.when(~kind.isin(*KINDS), F.substring("raw", 1, 200)).alias("raw_summary"),
    )


def fhir_text(json: Column) -> Column:
    """A resource as readable lines; kinds without a template give the first 500 characters of their JSON."""
    r = F.from_json(json, FHIR_ALL)
    get = lambda *path: F.coalesce(_path(r, path), F.lit("unknown"))
    head = F.concat(F.lit("FHIR "), F.coalesce(r["resourceType"], F.lit("Resource")), F.lit(":"))
    name = F.get(r["name"], 0)
    person = F.concat(F.lit("Name: "), F.concat_ws(" ", name["given"]), F.lit(" "), F.coalesce(name["family"], F.lit("")))
    lines = {
        "Patient": [F.trim(person), F.concat(F.lit("Birth Date: "), get("birthDate"))],
        "MedicationRequest": [F.concat(F.lit("Medication: "), get("medicationCodeableConcept", "text")), F.concat(F.lit("Dosage: "), F.coalesce(F.get(r["dosageInstruction"], 0)["text"], F.lit("unknown")))],
        "Observation": [F.concat(F.lit("Observation: "), get("code", "text")), F.concat(F.lit("Value: "), F.coalesce(r["valueQuantity"]["value"].cast("string"), F.lit("")), F.lit(" "), F.coalesce(r["valueQuantity"]["unit"], F.lit("")))],
        "Condition": [F.concat(F.lit("Condition: "), get("code", "text")), F.concat(F.lit("Status: "), F.coalesce(F.get(r["clinicalStatus"]["coding"], 0)["code"], F.lit("unknown")))],
    }
    out = F.concat_ws("\n", head, F.substring(json, 1, 500))
    for kind, xs in lines.items():
        out = F.when(r["resourceType"] == kind, F.concat_ws("\n", head, *xs)).otherwise(out)
    return out


def _path(r: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        r = r[p]
    return r


def hl7_segments(messages: DataFrame, column: str = "message") -> DataFrame:
    """msg_id, segments: array of field arrays, in order; blank lines left out."""
    lines = F.filter(F.transform(F.split(column, r"\r\n|[\n\r]"), F.trim), lambda x: x != "")
    return messages.select("msg_id", _once(F.transform(lines, lambda x: F.split(x, r"\|"))).alias("segments"))


def _last(kind: str) -> Column:
    return F.try_element_at(F.filter("segments", lambda f: f[0] == kind), F.lit(-1))


def hl7_basic(messages: DataFrame, column: str = "message") -> DataFrame:
    """msg_id, message_type, patient_id, patient_name, birth_date, observations (all of them): the loader's parser.

    A header of fewer than ten fields is ignored; missing fields of other segments are empty.
    """
    msh, pid, field = _last("MSH"), _last("PID"), lambda f, i: F.coalesce(F.get(f, i), F.lit(""))
    obx = F.transform(F.filter("segments", lambda f: f[0] == "OBX"), lambda f: F.struct(field(f, 3).alias("type"), field(f, 5).alias("value"), field(f, 6).alias("units")))
    long = F.size(F.get(F.filter("segments", lambda f: f[0] == "MSH"), 0)) > 9
    return hl7_segments(messages, column).select("msg_id", F.when(long, F.get(msh, 8)).alias("message_type"), F.when(long, F.get(msh, 3)).alias("patient_id"), F.when(pid.isNotNull(), field(pid, 5)).alias("patient_name"), F.when(pid.isNotNull(), field(pid, 7)).alias("birth_date"), obx.alias("observations"))


def hl7_full(messages: DataFrame, column: str = "message", keep_all: bool = False) -> DataFrame:
    """msg_id, message_type, date, patient_id, patient_name, observations, medications.

    Of repeated segments the last counts; ``keep_all`` keeps all observations and medications.
    """
    msh, pid, field = _last("MSH"), _last("PID"), lambda f, i: F.coalesce(F.get(f, i), F.lit(""))

    def items(kind: str, names: dict[str, int]) -> Column:
        every = F.filter("segments", lambda f: f[0] == kind)
        picked = every if keep_all else F.slice(every, F.greatest(F.size(every), F.lit(1)), 1)
        return F.transform(picked, lambda f: F.struct(*[field(f, i).alias(n) for n, i in names.items()]))

    obx = items("OBX", {"set_id": 1, "type": 3, "value": 5, "units": 6, "reference_range": 7, "abnormal_flag": 8, "status": 11})
    rxa = items("RXA", {"medication": 5, "dose": 6, "units": 7, "route": 12})
    empty = lambda f, i: F.coalesce(F.get(f, i), F.lit(""))
    return hl7_segments(messages, column).select("msg_id", empty(msh, 8).alias("message_type"), empty(msh, 6).alias("date"), F.get(pid, 3).alias("patient_id"), F.get(pid, 5).alias("patient_name"), obx.alias("observations"), rxa.alias("medications"))


def hl7_to_fhir(full: DataFrame) -> DataFrame:
    """resource_type, resource_id, patient_id, code, display, system, value: results as Observations, admissions as Encounters."""
    kind = F.split("message_type", r"\^")[0]
    part = lambda i: F.get(F.split("o.type", r"\^"), i)
    none = F.lit(None).cast("string")
    observations = full.where(kind == "ORU").select("*", F.posexplode("observations").alias("k", "o")).select(F.lit("Observation").alias("resource_type"), F.concat_ws("-", "msg_id", F.col("k") + 1).alias("resource_id"), "patient_id", part(0).alias("code"), part(1).alias("display"), part(2).alias("system"), F.col("o.value").alias("value"))
    encounters = full.where(kind == "ADT").select(F.lit("Encounter").alias("resource_type"), F.col("msg_id").cast("string").alias("resource_id"), "patient_id", none.alias("code"), none.alias("display"), none.alias("system"), none.alias("value"))
    return observations.unionByName(encounters)


def append_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def remove_document(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    return chunks.join(removed, "doc_id", "left_anti")


def dispatch(path: Column) -> Column:
    """struct(document_id, kind, requires_structured_path, load_error) by the extension of a path."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("txt", "rtf"), "text").when(ext == "pdf", "pdf").when(ext == "dcm", "dicom").when(ext == "hl7", "hl7_message").when(ext == "json", "fhir_resource")
    error = F.when(kind.isNull(), F.concat(F.lit("Unsupported file type: ."), ext))
    return F.struct(document_id(path).alias("document_id"), kind.alias("kind"), F.coalesce(kind.isin("hl7_message", "fhir_resource"), F.lit(False)).alias("requires_structured_path"), error.alias("load_error"))


def patient_and_type(name: Column) -> Column:
    """struct(patient, kind) from a file name."""
    kind = F.when(name.contains("discharge"), "discharge_summary").when(name.contains("lab"), "lab_report").when(name.contains("radiology"), "radiology_report").otherwise("progress_note")
    return F.struct(F.when(name.contains("patient_A"), "patient_A").otherwise("patient_B").alias("patient"), kind.alias("kind"))


def evaluation_set(json: DataFrame, column: str = "json") -> DataFrame:
    """A row a question of an evaluation set: id, patient, query_type, query, expected_keywords, difficulty, requires_docs."""
    question = "struct<id:string,patient:string,query_type:string,query:string,expected_keywords:array<string>,expected_section:string,gold_answer:string,difficulty:string,requires_docs:array<string>>"
    return json.select(F.inline(F.from_json(column, f"description string, version string, questions array<{question}>")["questions"]))


def pdf_text(content: bytes, name: str) -> str:
    """Text of a PDF by whichever reader is installed, else a placeholder."""
    import io

    for module in ("pypdf", "PyPDF2"):
        try:
            reader = __import__(module).PdfReader(io.BytesIO(content))
        except ImportError:
            continue
        return "\n".join(p.extract_text() or "" for p in reader.pages)
    return f"[PDF content of {name}: no reader installed]"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text_content, header, load_error of PDF and DICOM files; one that can't be read is a row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,dcm}").load(path).select("path", "content")
    return binary_contents(files)


def binary_contents(files: DataFrame) -> DataFrame:
    """``binary_files`` of (path, content), the kind by the path's end."""

    def read(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    header, text = dicom.read(content) if p.endswith(".dcm") else ({}, pdf_text(content, p.rsplit("/", 1)[-1]))
                    rows.append((p, text, header, None))
                except Exception as e:  # a broken file never ends the scan
                    rows.append((p, "", {}, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text_content", "header", "load_error"])

    return files.mapInPandas(read, "path string, text_content string, header map<string,string>, load_error string")
