"""Chunkers on texts with very many headers and paragraphs, and on every kind of white space, against plain definitions."""

import random
import re
import time

from pyspark.sql import functions as F

from tesselon.functions import rules
from tesselon.operators import chunking

random.seed(9)
BITS = ["PLAN", "Plan:", " ASSESSMENT ", "MEDICATIONS:\t", "\n", "\n\n", "\r\n", "\r", " ", "\t", "\x0b", "word", "é", "PLAN x", "ASSESSMENT AND PLAN:", " ", ":"]


def plain_sections(text, headers, keep, default):
    lines = re.split(r"\r\n|[\n\r]", text)
    ws = " \t\n\x0b\f\r"
    is_head = [bool(re.match(rf"(?:{headers})[:\s]*\Z", x.strip(ws), re.I | re.A)) for x in lines]
    heads = [0] + [i for i, h in enumerate(is_head) if h and i]
    out = []
    for k, h in enumerate(heads):
        end = heads[k + 1] if k + 1 < len(heads) else len(lines)
        body = lines[h + (1 if is_head[h] and not keep else 0) : end]
        name = re.sub(":+$", "", lines[h].strip(ws)).strip(ws).upper() if is_head[h] else default
        told = "\n".join(body).strip(ws)
        if told:
            out.append((name, sum(map(len, lines[:h])) + h, told))
    return out


def test_sections_of_odd_texts(spark):
    texts = ["".join(random.choice(BITS) for _ in range(random.randint(0, 30))) for _ in range(400)]
    for headers, keep, default in ((rules.HEADERS, True, "PREAMBLE"), (rules.EVALUATION_HEADERS, False, "HEADER")):
        df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
        got = {r.doc_id: r.s for r in df.select("doc_id", chunking.section_list(F.col("text"), headers, keep, default).alias("s")).collect()}
        assert got[900] is None
        for i, x in enumerate(texts):
            assert [tuple(s) for s in got[i]] == (plain_sections(x, headers, keep, default) or [("DOCUMENT", 0, x)]), repr(x)


def test_numbered_sections_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a\nPLAN\n\nASSESSMENT:\nb"), (2, None), (3, "  "), (4, " PLAN\nx")], "doc_id long, text string")
    out = chunking.sections(df, rules.HEADERS, keep_header=False)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "PREAMBLE", "a"), (1, 2, "ASSESSMENT", "b"), (4, 0, "PREAMBLE", "PLAN\nx")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_work_follows_the_length_of_a_text():
    """Ten times the headers and paragraphs take about ten times as long, not a hundred."""

    def took(n):
        text = "PLAN\nsome words here for the plan\n\nand more of them\n\n" * n
        header = chunking._header(rules.HEADERS)
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            found = chunking.split_sections(text, header, True, "PREAMBLE")
            packed = chunking.pack(text, 50, 160, 140, False)
            best = min(best, time.perf_counter() - at)
        assert len(found) == n and len(packed) > n // 4
        return best

    assert took(40_000) < 40 * max(took(4_000), 0.005)
