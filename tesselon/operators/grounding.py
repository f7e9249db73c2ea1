"""Which numbers and dictionary terms of an answer are not in its context.

Terms, of one word or several, are found by an automaton over the whole dictionary, so a text costs one pass whatever the
dictionary's size.  A dictionary of more than ``TERMS`` terms is cut into parts by the hash of the term, one automaton each;
findings of the parts are joined.  Texts are compared as words: lower case, one space between.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

TERMS = 500_000


def as_words(text: Column) -> Column:
    """The words of a text with a space before, between and after."""
    return F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(text, F.lit(""))), " "), F.lit(" "))


def automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in terms:
        a.add_word(f" {term} ", term)
    a.make_automaton()
    return a


def found_terms(texts: DataFrame, keys: list[str], column: str, terms: DataFrame) -> DataFrame:
    """keys, found: the sorted distinct terms (term) in each text; every row of texts gives a row a part of the dictionary."""
    words = terms.select(F.trim(as_words(F.col("term"))).alias("term")).where("term <> ''").distinct()
    parts = max(1, math.ceil(words.count() / TERMS))
    read = texts.select(*keys, as_words(F.col(column)).alias("words"))
    every = None
    for n in range(parts):
        some = sorted(r["term"] for r in words.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == n).collect())

        def run(batches, some=some):
            import pyarrow as pa

            known = automaton(some) if some else None
            for b in batches:
                hits = [sorted({t for _, t in known.iter(x)}) if known else [] for x in b.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(hits, pa.list_(pa.string()))], [*keys, "found"])

        fields = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
        one = read.mapInArrow(run, f"{fields}, found array<string>")
        every = one if every is None else every.unionByName(one)
    return every


NUMBER = re.compile(r"[0-9]+(?:[.][0-9]+)?").pattern


def ungrounded(pairs: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """keys, numbers, terms, grounded: what answer (text) has and its context (before) hasn't, sorted and distinct."""
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(True).alias("mine"), F.col("text").alias("t")), F.struct(F.lit(False).alias("mine"), F.col("before").alias("t")))).alias("x")).select(*keys, "x.*")
    found = found_terms(sides, [*keys, "mine"], "t", terms)
    of = lambda mine: F.flatten(F.collect_list(F.when(F.col("mine") == mine, F.col("found"))))
    terms_ = found.groupBy(*keys).agg(F.array_sort(F.array_except(of(True), of(False))).alias("terms"))
    number = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))
    numbers = pairs.select(*keys, F.array_sort(F.array_except(number(F.col("text")), number(F.col("before")))).alias("numbers"))
    return numbers.join(terms_, keys).withColumn("grounded", (F.size("numbers") == 0) & (F.size("terms") == 0))
