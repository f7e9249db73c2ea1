"""Secret scan, filter audit and fill-in-middle against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tesselon.llm import audit, infill, queries, secrets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, spans string, n string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y", "z") for i, t, s in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans_of(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def told(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


SECRET_TEXTS = [
    None,
    "",
    "é token=abcdef, TOKEN : \"Ünï.x\" paſſword=abcdefgh apiKey= 'a.b.c.d-e' api_key=short",
    "日本 AKIA" + "Q" * 16 + " AKIA" + "Q" * 15 + " xAKIAAKIA" + "Z9" * 9,
    "ab" * 11 + "x " + "0f" * 12 + " token=" + "0f" * 20 + "\ntoken=token=abcdefg secret=.....",
    "a" * 70_000 + " password=" + "b1" * 30_000,
    "token = token: xx secret secret='AKIA" + "B2" * 9 + "'",
    "ſecret=abcdefgh toKen=abcdefgh",
]


def test_rule_spans_equal_python(spark):
    random.seed(11)
    parts = ["token", "Secret", "=", ":", " ", '"', "'", "AKIA", "abcdef", "0123456789abcdef", "é", "\n", "-", "QRSTUVWXYZ012345", "passwd", "api_key", "日"]
    texts = SECRET_TEXTS + ["".join(random.choice(parts) for _ in range(random.randint(1, 40))) for _ in range(400)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "token=abcdef", None), (3, texts[3], "s")])
    got = secrets.scan(docs, secrets.Model([0] * secrets.N**2)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "token=abcdef" if r.doc_id is None else texts[r.doc_id] or ""
        assert [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans] == spans_of(text), text[:200]


def test_secret_digest_on_a_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_markov_secrets(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        want, r = spans_of(text), got[d]
        kinds = Counter(k for _, k, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2]) and r.base_sha256 == hashlib.sha256(told(want).encode()).hexdigest()
        assert set(told(want).split(",")) <= set(r.spans.split(","))


def brute_counts(texts):
    """Ordinary and random transitions by the definition, character by character."""
    run = re.compile(rf"[{re.escape(secrets.ALPHABET.decode())}]+")
    at = {c: i for i, c in enumerate(secrets.ALPHABET.decode())}
    rand, other = Counter(), Counter()
    for t in texts:
        base, values = set(), set()
        for kind, p, group, least in (("a", ASSIGN, 2, 6), ("k", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("h", re.compile("[0-9a-f]+"), 0, 24)):
            for m in p.finditer(t):
                if len(m[group]) >= least:
                    base |= set(range(*m.span()))
                    if re.search("[A-Za-z]", m[group]) and re.search("[0-9]", m[group]):
                        values |= set(range(*m.span(group)))
        runs = list(run.finditer(t))
        for m in runs:
            for i in range(m.start(), m.end() - 1):
                a, b = t[i], t[i + 1]
                if i in values and i + 1 in values:
                    rand[at[a], at[b]] += 8
                if i not in base and i + 1 not in base:
                    other[at[a], at[b]] += 8
                    other[at[a.upper()], at[b.upper()]] += 8
        for x, y in zip(runs, runs[1:]):
            if x.start() not in base and y.start() not in base:
                e, s = x[0][-1], y[0][0]
                for pair in ((e, s.upper()), *((e, c) for c in "_-/"), *((c, s) for c in "_-/")):
                    other[at[pair[0]], at[pair[1]]] += 1
    return rand, other


def test_chains_count_every_transition():
    texts = [t or "" for t in SECRET_TEXTS[:5]] + ["some_name otherName x-y", "token=abc123def4 tail", "", "end"]
    got = secrets.count_steps(pa.array(texts))
    for have, want in zip(got, brute_counts(texts)):
        assert {(int(i) // secrets.N, int(i) % secrets.N): int(have[i]) for i in np.flatnonzero(have)} == {k: v for k, v in want.items() if v}


def test_chains_on_held_out_samples(spark):
    """Trained on three quarters of the rows: random strings of other alphabets are found, ordinary runs and names aren't."""
    from tesselon.llm.toxicity import held_out

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.fit(docs.where(~held_out(docs.doc_id)))
    random.seed(2)
    draw = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    strings = [draw(a, n) for a in ("0123456789abcdef", string.ascii_letters + string.digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for n in (20, 22, 23) for _ in range(100)]
    found = [any(s["kind"] == "random" and s["end"] - s["start"] == len(x) for s in spans) for x, spans in zip(strings, secrets.find_spans(pa.array(strings), model))]
    assert sum(found) >= 0.95 * len(found)
    names = "getHttpServletRequestUriString INTERNATIONALIZATION some_snake_case_name_here user-profile-settings-page com/en/article/some-title-here 12345678901234567890".split()
    assert not any(secrets.find_spans(pa.array(names + ["z" * 99, "=" * 99, "xy" * 50]), model)[i] for i in range(len(names) + 3))
    rest = secrets.scan(docs.where(held_out(docs.doc_id)), model).collect()
    assert sum(s.kind == "random" for r in rest for s in r.spans) <= 0.01 * len(rest)


def test_chains_from_labelled_values_and_without_samples(spark):
    random.seed(4)
    rows = [("".join(random.choice(string.ascii_letters + string.digits) for _ in range(24)), True) for _ in range(200)]
    rows += [(w, False) for w in "customer_account_number internationalisation shipping-address configuration" .split()] * 50 + [(None, True), ("x", None)]
    model = secrets.fit_labelled(spark.createDataFrame(rows, "value string, secret boolean"))
    kinds = lambda x: [s["kind"] for s in secrets.find_spans(pa.array([x]), model)[0]]
    assert kinds("see qX7Lw2ZpT9mKd4Vb8RcY1n here") == ["random"] and kinds("customer_account_configuration") == []
    none = frame(spark, [])
    assert secrets.find_secrets(none).count() == 0 and set(secrets.fit(none).weights) == {0}
    blank = secrets.find_secrets(frame(spark, [(1, None, None), (1, None, None), (None, "", "s")])).collect()
    assert len(blank) == 3 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in blank)


# ---------------------------------------------------------------- audit of filters


def brute_audit(rows, quality, toxic):
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)
        docs.append((s or "", d, (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), again)))
    out = {}
    for part in {p for p, _, _ in docs}:
        mine = [(d, f) for p, d, f in docs if p == part]
        total = Counter()
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone, redundant = [x for x in left if x[1][f]], sum(x[1][f] for x in mine) - sum(x[1][f] for x in left)
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                unique = sum(x[1][f] and sum(x[1]) == 1 for x in mine)
                out[part, "".join("ABCDE"[i] for i in order), step + 1] = [len(left), len(gone), redundant, unique, sum(d in quality for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total["ABCDE".index(order[step - 1])])
    return out


def test_audit_equals_brute_force(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(600)]
    rows = [(0, None, None), (None, "", ""), (None, "", "a"), (4, "", "a"), (4, "", "a"), (9, "x" * 90_000, "a")]
    for i in range(60):
        n = random.choice((3, 199, 200, 260))
        t = " ".join(random.choice(words[:40] if i % 3 else words) for _ in range(n))
        rows.append((random.randint(5, 40), t + random.choice(("", " # ", "　É", " SHOUT" * 40)), random.choice("abc")))
    rows += [(random.choice((1, 50, 60)), rows[-1][1], s) for s in "abcaa"] * 3
    marks = [(d, random.choice((0, 1, None)), random.choice((0, 1))) for d in range(0, 60, 2) for _ in range(2)] + [(None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(frame(spark, rows), labels).collect()
    want = brute_audit(rows, {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, x in marks if x == 1 and d is not None})
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]
    assert audit.audit_filters(frame(spark, []), labels).count() == 0
    assert audit.audit_filters(frame(spark, rows[:3]), labels.where("false")).count() == 1200


def test_outcomes_partition_the_masks():
    (kept, removed, redundant, unique), orders = audit.outcome_matrices(5)
    assert kept.shape == (32, 600) and len(orders) == 120
    cube = removed.reshape(32, 120, 5)
    assert (cube.sum(axis=2) == (np.arange(32) > 0)[:, None]).all() and (kept.reshape(32, 120, 5)[:, :, -1] == (np.arange(32) == 0)[:, None]).all()
    assert (unique <= removed).all() and (removed * redundant == 0).all()


# ---------------------------------------------------------------- fill-in-middle

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "characters": r"(?s:.)"}


def brute_infill(doc_id, text, seed, rate, spm, unit):
    text = text or ""
    if unit == "words":
        at = [m.start() for m in re.finditer(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]", text) if m.start()]
        edges = [0, *at, len(text)]
        units = [text[a:b] for a, b in zip(edges, edges[1:]) if a < b]
    else:
        units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force(spark):
    random.seed(8)
    pieces = ["a", "é", "日本", "\n", "\n\n", " ", "\t", "word", "<", "<S", "P>", "\r\n", "\x00", "😀"]
    texts = [None, "", "\n", "no feed", "<P>", "x<M>y", "a\n" * 40_000, "z" * 70_000] + ["".join(random.choice(pieces) for _ in range(random.randint(1, 30))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a\nb\nc", "s"), (9, texts[9], "s")]
    docs = frame(spark, rows)
    for seed, rate, spm, unit in ((7, 100, 50, "lines"), (3, 60, 20, "words"), (5, 90, 80, "characters")):
        cut = infill.transform(docs, seed, rate, spm, unit)
        got = cut.withColumn("again", infill.restore(cut.output, cut.form)).collect()
        assert len(got) == len(rows) and cut.columns[-5:] == ["n", "form", "prefix_chars", "middle_chars", "output"]
        for r in got:
            text = "a\nb\nc" if r.doc_id is None else texts[r.doc_id]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infill(r.doc_id, text, seed, rate, spm, unit)
            assert r.again == (text or "") and r.text == text and r.part == "z"
    assert infill.transform(frame(spark, [])).count() == 0


def test_batches_are_cut_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "c", "", "d" * 9])], ["t"])
    assert [x.column(0).to_pylist() for x in infill.slices(b, 0, 10)] == [["aa", None], ["b" * 50], ["c", "", "d" * 9]]
    assert zlib.crc32(b"".join(x.column(0).cast(pa.binary()).fill_null(b"")[0].as_py() for x in infill.slices(b, 0, 10))) == zlib.crc32(b"aa" + b"b" * 50 + b"c")
