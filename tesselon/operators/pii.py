"""Personal data as spans: detection, overlap rule, pseudonyms, masked texts, and the checks built on them.

Spans need positions, which no built-in expression gives for all matches, so texts go
through Arrow batches; types and constant labels are plain columns (``functions.text``).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import pii_types

ENTITY = "array<struct<kind:string,start:int,stop:int,pseudonym:string>>"
BLOCKED, FAILED = rules.BLOCKED, rules.FAILED


class Detector:
    """Non-overlapping entities of a text: the first by start wins, at one start the earlier rule."""

    def __init__(self, salt: str = "salt"):
        self.salt = salt
        self.rules = [(k, re.compile(p), dict(rules.rows(rules.PSEUDONYMS))[k]) for k, p in rules.rows(rules.PII)]

    def label(self, kind: str, form: str, original: str) -> str:
        if "#" not in form:
            return form
        return form.replace("#", hashlib.sha256(f"{self.salt}:{kind}:{original}".encode()).hexdigest()[:8])

    def __call__(self, text: str | None) -> list[tuple[str, int, int, str]]:
        found = []
        for n, (kind, rule, form) in enumerate(self.rules):
            group = 1 if kind == "person_name" else 0
            found += [(m.start(group), n, m.end(group), kind, self.label(kind, form, m[group])) for m in rule.finditer(text or "")]
        kept, end = [], 0
        for start, _, stop, kind, label in sorted(found):
            if not kept or start >= end:
                kept.append((kind, start, stop, label))
                end = stop
        return kept


def masked(text: str | None, entities: list[tuple[str, int, int, str]]) -> str | None:
    if not entities:
        return text
    out, at = [], 0
    for _, start, stop, label in entities:
        out += [text[at:start], label]
        at = stop
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, key: str = "doc_id", column: str = "text", salt: str = "salt", enabled: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, text (masked), entities, and the columns ``keep`` as they are.  Where detection is off, texts pass through without entities; null stays null."""
    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        import pyarrow as pa

        find = Detector(salt)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(x) if enabled else [] for x in texts]
            rows = [[{"kind": k, "start": a, "stop": z, "pseudonym": p} for k, a, z, p in e] for e in found]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("pseudonym", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(masked, texts, found), pa.string()), pa.array(rows, kinds), *b.columns[2:]], [key, "text", "entities", *keep])

    return docs.select(key, F.col(column).cast("string").alias("text"), *keep).mapInArrow(run, f"{key} {kind}, text string, entities {ENTITY}{more}")


def mapping(detected: DataFrame) -> DataFrame:
    """The distinct (kind, pseudonym) of all texts; originals are never kept."""
    return detected.select(F.explode("entities").alias("e")).select("e.kind", "e.pseudonym").distinct()


def validate(answer: Column, sanitised: Column, block: bool = True) -> Column:
    """struct(is_valid, answer, blocked, reason, warning): personal data blocks an answer or is masked; errors are replaced."""
    types = F.array_join(pii_types(answer), ", ")

    def result(valid: bool, text: Column, blocked: bool, reason: Column, warning: Column) -> Column:
        return F.struct(F.lit(valid).alias("is_valid"), text.alias("answer"), F.lit(blocked).alias("blocked"), reason.alias("reason"), warning.alias("warning"))

    none = F.lit(None).cast("string")
    found = result(False, F.lit(BLOCKED), True, F.concat(F.lit(rules.PII_REASON), types), none) if block else result(True, sanitised, False, none, F.concat(F.lit(rules.PII_WARNING), types))
    failed = result(False, F.lit(FAILED), False, none, F.lit(rules.GENERATION_ERROR))
    return F.when(types != "", found).when(answer.startswith("[LLM Error"), failed).otherwise(result(True, answer, False, none, none))


def cleaner(salt: str = "salt"):
    """The function of a text that ``clean`` maps: each rule passes once over the text so far.  Classes and word ends are ASCII, as in the SQL."""
    forms = dict(rules.rows(rules.EVALUATION_PSEUDONYMS))

    def label(kind: str, form: str):
        before, hashed, after = form.partition("#")
        if not hashed:
            return lambda m: form
        return lambda m: f"{before}{hashlib.sha256(f'{salt}:{kind}:{m[0]}'.encode()).hexdigest()[:8]}{after}"

    steps = [(re.compile(p, re.A), label(k, forms[k])) for k, p in rules.rows(rules.EVALUATION_PII)]

    def run(text: str | None) -> str | None:
        if text:
            for rule, put in steps:
                text = rule.sub(put, text)
        return text

    return run


def clean(text: Column, salt: str = "salt") -> Column:
    """The evaluation variant: one rule after the other over the text so far, each match replaced.

    As nested expressions, a rule with a hash would evaluate all rules before it twice.
    """
    return F.udf(cleaner(salt), "string", useArrow=True)(text.cast("string"))


def evaluation_types(text: Column) -> Column:
    """The rules of the evaluation variant that match, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.rows(rules.EVALUATION_PII)]))


def reidentification(text: Column) -> Column:
    """struct(categories, severity): quasi-identifiers (age, date, place) that together single a person out."""
    flags = {k: text.rlike(p) for k, p in rules.rows(rules.QUASI_IDENTIFIERS)}
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    direct = F.size(F.array_intersect(pii_types(text), F.array(*map(F.lit, ("ssn", "mrn", "person_name"))))) > 0
    severity = F.when(direct & (n >= 1), "CRITICAL").when(direct | (n >= 3), "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")
    return F.struct(F.array_compact(F.array(*[F.when(f, F.lit(k)) for k, f in flags.items()])).alias("categories"), severity.alias("severity"))
