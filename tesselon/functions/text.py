"""Text columns: tokens, estimates, personal data, pseudonyms, document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

WORD = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def pii_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in rules.rows(rules.PII)}


def pii_types(text: Column) -> Column:
    """Sorted distinct types found."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.rows(rules.PII)])))


def pseudonym(kind: str, original: Column, salt: str = "salt") -> Column:
    label = dict(rules.rows(rules.PSEUDONYMS))[kind]
    mark = F.substring(F.sha2(F.concat(F.lit(f"{salt}:{kind}:"), original), 256), 1, 8)
    before, _, after = label.partition("#")
    return F.concat(F.lit(before), mark, F.lit(after)) if "#" in label else F.lit(label)


def mask_constant(text: Column, kinds: tuple[str, ...]) -> Column:
    patterns, labels = dict(rules.rows(rules.PII)), dict(rules.rows(rules.PSEUDONYMS))
    for k in kinds:
        text = F.regexp_replace(text, patterns[k], labels[k])
    return text


def mask_hashed(text: Column, kind: str, label: str, salt: str = "salt") -> Column:
    """Every match replaced by a label with its own hash: pieces between matches and hashes are zipped."""
    p = dict(rules.rows(rules.PII))[kind]
    found = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.concat(F.lit(f"[{label}_"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:{kind}:"), x), 256), 1, 8), F.lit("]")))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, p, -1).alias("a"), found.alias("b")), lambda z: F.array(z["a"], F.coalesce(z["b"], F.lit(""))))), "")


def first_match(text: Column, table: str, default: str) -> Column:
    """The name of the first rule of a table that the lower-cased text matches."""
    low = F.lower(text)
    out = F.lit(default)
    for name, pattern in reversed(rules.rows(table)):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def clinical_type(text: Column) -> Column:
    return first_match(text, rules.DOCUMENT_TYPES, "clinical_note")


def preview(text: Column) -> Column:
    return F.concat(F.translate(F.substring(text, 1, 120), "\n", " "), F.when(F.length(text) > 120, "...").otherwise(""))
