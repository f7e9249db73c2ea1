"""The whole pipeline against brute force on sf0.001: plain Python for every stage, the tokenizers library for the ids."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np

from tesselon.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def components(sets, percent):
    label = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and label[x] != label[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                low, high = sorted((label[x], label[y]))
                label = {i: low if c == high else c for i, c in label.items()}
    return label


def without_repeats(texts):
    first = {}
    for d, raw in sorted(texts.items()):
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    out = {}
    for d, raw in texts.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(raw, gone) if not g).decode(errors="ignore") if any(gone) else raw.decode()
    return out


def leaks(text, items):
    where = defaultdict(list)
    for n, item in enumerate(items):
        for q, w in enumerate(item):
            where[w].append((n, q))
    lines = defaultdict(list)
    for p, w in enumerate(re.findall(r"[^\W_]+", text.lower())):
        for n, q in where.get(w, ()):
            lines[n, p - q].append(q)
    for (n, _), qs in lines.items():
        width = min(13, len(items[n]))
        need = math.ceil(width * 0.8)
        qs = sorted(qs)
        if any(b - a < width for a, b in zip(qs, qs[need - 1 :])):
            return True
    return False


def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    grammar, (*weights, bias) = toxicity.Grammar(model.lexicon), model.coefficients
    score = lambda t: 1 / (1 + math.exp(-(bias + sum(a * b for a, b in zip(weights, grammar.features(t))))))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    calm = {d: t for d, t in texts.items() if score(t) < 0.3}
    sets = {}
    for d, t in calm.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = components(sets, 80)
    cut = without_repeats({d: t.encode() for d, t in calm.items() if label[d] == d})
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: t for d, t in cut.items() if not leaks(t, items)}
    assert len(texts) > len(calm) > len(cut) > len(clean)
    tok, want = Tokenizer.from_file(queries.vocabulary(queries.BYTE_VOCABULARY)), set()
    for d, t in clean.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want |= {(d, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024)}
    rows = cp.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want and len(rows) == len(want)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_on_odd_and_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    copy, passage = prose(80), prose(40)
    rows = [(1, copy, "a"), (2, copy, "b"), (3, None, "c"), (4, "", "d"), (5, prose(20) + " " + passage, "e"), (6, prose(20) + " " + passage, "f"), (None, copy, "g"), (None, None, "h"), (7, prose(30_000), "i")]
    schema = "doc_id long, text string, score string"
    labels = "doc_id long, quality int, toxic int"
    for name, some in (("odd", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, prose(15))] if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = cp.run(spark, at).collect()
        lengths = defaultdict(int)
        for r in got:
            lengths[r.doc_id] += r.length
        assert set(lengths) == ({1, 3, 4, 5, 6, 7} if some else set())
        if some:
            assert lengths[3] == lengths[4] == 1 and lengths[6] < lengths[5] and all(lengths[r.doc_id] == r.doc_tokens for r in got)
