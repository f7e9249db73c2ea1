"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.llm import blocks, decontam, gif, induced, minhash, packing, queries, shards, substrings, suffixes, token_files, toxicity, urls

random.seed(5)
VOCAB = ["w" + "".join(random.choice("abcdeéß") for _ in range(random.randint(1, 7))) for _ in range(300)]


def prose(n):
    return " ".join(random.choice(VOCAB) for _ in range(n))


SHARED = prose(40)
BASE = prose(60)
TEXTS = [None, "", "x", " \n\t ", prose(5), BASE, BASE, BASE + " tail", "q " + BASE, SHARED, prose(20) + " " + SHARED + "\n" + prose(9), "a" * 300, "a" * 120 + "b", prose(3000) + SHARED, "日本 語 <|endoftext|> é", prose(13), BASE.translate({c: c - 32 for c in range(97, 123)})]
ROWS = [(i * 3, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id " + BASE, 1)]
SCHEMA = "doc_id long, text string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def known():
    return [(d, t or "") for d, t, _ in ROWS if d is not None]


def test_gif_round_trip(docs, empty):
    got = {r.doc_id: r for r in gif.text_media(docs).collect()}
    for d, t in known():
        raw = t.encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[d].payload_sha256 == hashlib.sha256(p).hexdigest() and got[d].tail_crc32 == zlib.crc32(p[-32:])
    assert len(got) == len(known()) and gif.text_media(empty).count() == 0


def test_gif_random_bytes_both_decoders():
    for p in (os.urandom(576 * 4), bytes(576 * 2), bytes(range(256)) * 9):
        media = gif.encode_samples(p)
        _, frames = gif._parse(media)
        assert gif.read_samples(media)[0] == p
        assert list(gif._samples(frames)) == [gif.lzw_decode(f["data"], 8, f["box"][2] * f["box"][3]) for f in frames]


def test_gif_disposal_and_transparency():
    import struct

    def frame(x, colour, disposal, clear=None):
        flags = disposal << 2 | (clear is not None)
        lzw = gif._pack_codes([gif._lzw_codes(bytes([colour]))])[0]
        return b"\x21\xf9\x04" + struct.pack("<BHB", flags, 5, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", x, 0, 1, 1, 0) + b"\x08" + bytes([len(lzw)]) + lzw + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0xF7, 0, 0) + bytes(x for i in range(256) for x in (i, 0, 0))
    shown = list(gif.decode_gif(head + frame(0, 9, 1) + frame(1, 7, 2) + frame(0, 3, 3) + frame(1, 5, 1, 5) + b"\x3b"))
    assert [f["rgba"][0, :, 0].tolist() for f in shown] == [[9, 0], [9, 7], [3, 0], [9, 0]]
    assert [f["start_ms"] for f in shown] == [0, 50, 100, 150]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, empty, planes):
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.WORD_VOCABULARY)
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_files.token_files(docs, path, False, 2, planes=planes, block=100, file_ids=900).collect()}
    at = 0
    for d, t in sorted(known()):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_files(empty, path, False, 2).count() == 0


def test_packing(docs, empty):
    path = queries.vocabulary(queries.BYTE_VOCABULARY)
    rows = packing.pack_documents(docs, path, size=64).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    per = collections.Counter()
    for r in rows:
        per[r.doc_id] += r.length
    assert all(per[r.doc_id] == r.doc_tokens for r in rows) and set(per) == {d for d, _ in known()}
    assert packing.pack_documents(empty, path).count() == 0
    h = {random.randint(1, 64): random.randint(1, 50) for _ in range(40)}
    back = collections.Counter()
    for c, xs in packing.pack_histogram(h, 64):
        assert sum(xs) <= 64
        for x in xs:
            back[x] += c
    assert back == h


def test_suffix_array():
    for k in range(200):
        s = bytes(random.choice(b"ab" if k % 3 else b"abcdefghij") for _ in range(random.randint(1, 120)))
        t = np.frombuffer(s, dtype=np.uint8)
        assert induced.suffix_array(t, 256, random.choice((2, 10**6))).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(docs, empty):
    first = {}
    for d, t in sorted(known()):
        w = t.encode()
        for i in range(len(w) - 49):
            first.setdefault(w[i : i + 50], d)
    got = {r.doc_id: r for r in suffixes.dedup_suffixes(docs).collect()}
    for d, t in known():
        w, g = t.encode(), bytearray(len(t.encode()))
        for i in range(len(w) - 49):
            if first[w[i : i + 50]] < d:
                g[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(w, g) if not y)
        assert (got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest())
    assert suffixes.dedup_suffixes(empty).count() == 0


def test_substring_dedup(docs, empty):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for d, t in known()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    got = {r.doc_id: r for r in substrings.dedup_windows(docs).collect()}
    for d, w in words.items():
        g = [0] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                g[i : i + 13] = [1] * 13
        kept = b" ".join(x for x, y in zip(w, g) if not y)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(g), hashlib.sha256(kept).hexdigest())
    assert substrings.dedup_windows(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=85).collect()}
    assert got[0] == (0, 0, True) and got[3] == (0, 3, True)
    assert got[15][1] == got[18][1] == got[21][1] == got[24][1] == got[48][1] == 15 and got[15][2] and not got[18][2]
    assert got[27][1] == 27
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_chain(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):  # neighbours differ a little, ends a lot
        w = list(words)
        for k in range(i):
            w[k * 6] = f"x{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    parent = list(range(30))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {i: find(i) for i in range(30)}


def test_suffix_dedup_splits_a_hot_key(spark, monkeypatch):
    random.seed(5)
    phrase = "one very common phrase of the corpus"
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(60))
    rows = [(i, f"{word()} {phrase} {word()}") for i in range(300)]
    rows += [(1000 + i, rows[i][1][5:]) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: tuple(r) for r in suffixes.dedup_suffixes(docs).collect()}
    texts, _ = blocks.blocked(docs, 4096)
    monkeypatch.setattr(suffixes, "blocked", lambda d: (texts, 1 << 20))
    monkeypatch.setattr(suffixes, "SHARD_TEXT", 16384)
    monkeypatch.setattr(suffixes, "HOT_TEXT", 4096, raising=False)
    monkeypatch.setattr(suffixes, "HOT_WINDOWS", 500, raising=False)
    sort = suffixes.window_minima

    def bounded(texts, low, span):
        assert sum(map(len, texts)) <= 16384, "a shard's text"
        return sort(texts, low, span)

    monkeypatch.setattr(suffixes, "window_minima", bounded)
    got = {r.doc_id: tuple(r) for r in suffixes.dedup_suffixes(docs).collect()}
    assert got == want and all(want[1000 + i][2] == len(rows[i][1]) - 5 for i in range(0, 300, 3))


def test_decontamination_tolerates_substitutions(spark):
    item = prose(30)
    w = item.split()
    w[4], w[15], w[27] = "zzz", "yyy", "vvv"
    docs = spark.createDataFrame([(1, prose(50) + " " + item), (2, prose(20) + " " + " ".join(w) + " " + prose(5)), (3, prose(80)), (4, None), (5, ""), (None, item), (6, "one two three four")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two three four")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r["at"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 7): (30, 50), (2, 7): (27, 20), (6, 10): (3, 1)}
    assert decontam.contaminated(docs.where("false"), bench).count() == 0 == decontam.contaminated(docs, bench.where("false")).count()


def test_shards(spark, docs, empty):
    from pyspark.sql import functions as F

    full = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    rows = shards.hilbert_shards(full, 4).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.hilbert_shards(empty.withColumns({"lang": F.lit("en"), "source": F.lit("s")})).count() == 0


def test_hilbert_neighbours(spark):
    from pyspark.sql import functions as F

    cells = spark.range(64).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).alias("b"))
    path = [(r.a, r.b) for r in cells.withColumn("h", shards.hilbert_index([F.col("a"), F.col("b")], 3)).orderBy("h").collect()]
    assert all(abs(x - u) + abs(y - v) == 1 for (x, y), (u, v) in zip(path, path[1:]))


def test_urls(spark):
    rules = [urls.prefix_rule(*r) for r in queries.URL_RULES]
    pages = spark.createDataFrame([(1, "https://A.Example.com/en/70?x"), (2, "http://com/en/"), (3, "http://xcom/en/"), (4, None), (5, "nourl"), (6, "ftp://example.net/de/8#a"), (7, "http://example.net"), (1, "http://b.com/en/x")], "page_id long, url string")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()]
    assert got == [(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "example.net/de/8", "block"), (7, None, "allow"), (1, "com/en/", "block")]


def test_toxicity_grammar_and_fit(spark):
    g = toxicity.Grammar({"fool": 3.0})
    feature = lambda t: [n for n, x in zip(toxicity.FEATURES, g.features(t)) if x]
    assert feature("what a fool") == ["bare"] and feature("you are a fool") == ["targeted"]
    assert feature("you are not a fool") == ["negated"] and feature("he said you fool") == ["reported"]
    assert feature("I will hurt you") == ["threat"] and feature("you. fool") == ["bare"] and feature(None) == []
    rows = [(i, prose(30) + (" you fool" if i % 4 == 1 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    wrong = [r for r in out if r.doc_id < 400 and r.predicted != int(r.doc_id % 4 == 1)]
    assert not wrong and all(0 <= r.score <= 1 for r in out) and len(out) == 402
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect())


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp

    sf, d = "/root/testdata/sf0.001", None
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [d.count()]
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        d = spark.createDataFrame(out.collect(), out.schema)
        seen.append(d.count())
    assert seen == sorted(seen, reverse=True) and seen[2] < seen[1] and seen[4] < seen[3]
    assert decontam.contaminated(d, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    ids = {r.doc_id for r in cp.STAGES[4][1](spark, d, sf).collect()}
    assert ids == {r.doc_id for r in d.collect()}


def test_part_encoder_equals_the_library():
    from tokenizers import Tokenizer

    from tesselon.llm.tokens import PartEncoder

    rnd = random.Random(3)
    every = [chr(c) for c in range(0x250)]
    usual = [*"abcXYZ'  \n.,!019éÉßżŽ×÷ªµ", "'s", "'LL", " , ", ". ", ".\n", "don't", "İ", "ı", "ſ", "ŉ", "ǅ", "<|endoftext|>", "日"]
    texts = [w for c in every for w in (c, "a" + c, c + "a", "'" + c, f" {c} ", f"x{c}.{c}, y")]
    texts += ["".join(rnd.choice(usual if rnd.random() < 0.8 else every) for _ in range(rnd.randint(1, 30))) for _ in range(6000)]
    for name, spaces in ((queries.WORD_VOCABULARY, False), (queries.BYTE_VOCABULARY, True)):
        path = queries.vocabulary(name)
        own, library = PartEncoder(path, spaces, cache=3000), Tokenizer.from_file(path)
        got = [x for i in range(0, len(texts), 200) for x in own.encode_many(texts[i : i + 200])]
        wrong = [t for t, x in zip(texts, got) if x != np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()]
        assert not wrong, wrong[:5]


def test_repeated_doc_ids_in_token_files(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a"), (1, "b b"), (0, None), (2, "x " * 200_000)], "doc_id long, text string")
    rows = sorted(token_files.token_files(docs, queries.vocabulary(queries.WORD_VOCABULARY), False, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [0, 1, 1, 1, 2] and sorted(r.n_tokens for r in rows[1:4]) == [2, 3, 3] and rows[4].n_tokens == 200_001
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_packed_ids_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary(queries.BYTE_VOCABULARY)
    tok, texts = Tokenizer.from_file(path), dict(known())
    for r in packing.pack_documents(docs, path, size=64, with_ids=True).collect():
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        piece = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
        assert (r.ids, r.ids_crc32, r.doc_tokens) == (piece, zlib.crc32(piece), len(ids))


def test_decontamination_misses_no_substitutions(spark):
    """Every set of substitutions that the rule accepts, for items of 3 to 13 tokens, against the rule itself."""
    import itertools
    import math

    items, texts = [], []
    for n in range(3, 14):
        w = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        for m in range(n - math.ceil(0.8 * n) + 2):
            for gone in itertools.combinations(range(n), m):
                texts.append((n, m <= n - math.ceil(0.8 * n), " ".join(["pre", "lude", *("zz" if k in gone else x for k, x in enumerate(w)), "end"])))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, n) for i, (n, ok, _) in enumerate(texts) if ok}


def test_decontamination_odd_rows(spark):
    item = prose(30)
    rows = [(1, item, "k"), (1, item, "k"), (1, "other " + prose(20), "k"), (2, (prose(5000) + " ") * 10 + item, "k"), (None, item, "k"), (None, "clean", "k"), (3, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    bench = spark.createDataFrame([(7, item, "s"), (7, item, "s"), (None, "never seen anywhere at all", "s")], "item_id long, text string, seed string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()) == [(1, 7), (2, 7)]
    left = decontam.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "None"]


def test_near_duplicates_of_shared_doc_ids(spark):
    a, b = prose(80), prose(80)
    rows = [(2, a), (5, a), (5, b), (7, b + " tail"), (2, b + " another"), (9, prose(80)), (9, ""), (5, None), (None, a)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, component int")
    got = minhash.near_duplicates(docs, percent=80).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(2, 2, True), (5, 2, False), (7, 2, False), (9, 9, True)} and len(got) == 8
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "9", "9", "None"]


def test_near_duplicates_equal_brute_force_on_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for x in sorted(sets):
        for y in sorted(sets):
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]) and label[x] != label[y]:
                low, high = sorted((label[x], label[y]))
                label = {i: low if c == high else c for i, c in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows), percent=85).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as cp

    extra = ["score", "patterns", "predicted", "held_out", "_crc", "_bytes", "block", "key", "component_id", "held_0", "bucket"]
    texts = [None, "", "short", BASE, BASE, BASE + " tail", SHARED + " " + prose(30), prose(30) + " " + SHARED, "y " * 60_000]
    rows = [(i if i < 8 else None, t, "en", "s", 1, *[f"{c}{i}" for c in extra]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0, name
        docs = spark.createDataFrame(out.collect(), schema)
        assert all(r[c][len(c) :] == r.score[5:] for r in docs.collect() for c in extra), name
    left = {r.score: r.text for r in docs.collect()}
    assert set(left) == {f"score{i}" for i in (0, 1, 2, 3, 6, 7, 8)} and left["score3"] == BASE and SHARED not in left["score7"] and left["score8"] == texts[8]
    assert {r.doc_id for r in cp.STAGES[4][1](spark, docs, "").collect()} == {r.doc_id for r in docs.collect() if r.doc_id is not None}


def test_toxicity_composes_negation_reports_quotes_and_targets():
    g = toxicity.Grammar({"idiot": 3.0})
    feature = lambda t: [n for n, x in zip(toxicity.FEATURES, g.features(t)) if x]
    assert feature("I will never hurt you") == ["negated_threat"] and feature("he said I will hurt you") == ["reported_threat"]
    assert feature("he said: you are an idiot") == ["reported"] and feature('"Hello". You idiot') == ["targeted"]
    assert feature("The plan will beat the market") == [] and feature("I will hurt you") == ["threat"]
    assert feature('He wrote "so what. you idiot" and left. you idiot') == ["targeted", "reported"]
    assert feature("«toi idiot» fin. toi idiot") == ["targeted", "reported"] and feature('an open " quote\nyou idiot') == ["targeted"]
    assert g.features("such an idiot")[0] > g.features("an idiot")[0] < g.features("idiot idiot")[0]


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot " + prose(5), "s"), (1, "you idiot " + prose(5), "s"), (2, prose(60_000) + " you moron", "s"), (None, "you idiot", "s"), (None, "fine", "s"), (3, None, "s")], "doc_id long, text string, score string")
    rows = [(i, prose(30) + (" you moron" if i % 4 == 1 else "")) for i in range(100, 500)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 1)) for i, _ in rows], "doc_id long, toxic int"))
    assert sorted((r.doc_id, r.predicted) for r in toxicity.score(docs, model).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0)]
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("3", "None"), ("None", "fine")]
    assert toxicity.score(docs.where("false"), model).count() == 0 == toxicity.reject(docs.where("false"), model).count()


def test_gif_query_stores_timed_frames(spark):
    texts = ["", "é" * 700, "".join(chr(32 + i % 90) for i in range(576 * 9)), "z" * 576 * 5, prose(200_000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x"), (None, "none", "x")]
    got = gif.text_media(spark.createDataFrame(rows, "doc_id long, text string, feature string"), keep_media=True).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 2, 3, 4]
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        shown = list(gif.decode_gif(bytes(r.media)))
        assert b"".join(f["rgba"][..., 0].tobytes() for f in shown) == payload and r.n_frames == len(payload) // 576 == len(r.frames)
        assert [f.start_ms for f in r.frames] == [40 * i for i in range(r.n_frames)]
        for i, f in enumerate(r.frames):
            red = np.frombuffer(payload[576 * i : 576 * i + 576], np.uint8).astype(int)
            for have, channel in ((f.hist_red, red), (f.hist_green, 255 - red), (f.hist_blue, red * 7 & 255)):
                assert have == np.bincount(channel >> 5, minlength=8).tolist()
    _, frames = gif._parse(bytes(next(r.media for r in got if r.doc_id == 2)))
    assert {f["disposal"] for f in frames} == {1, 2, 3} and any(f["clear"] is not None for f in frames) and len({f["palette"] for f in frames}) == 2
    _, frames = gif._parse(bytes(next(r.media for r in got if r.doc_id == 3)))
    assert any(f["box"] != (0, 0, 24, 24) for f in frames)


def test_gif_frames_of_a_column(spark):
    media = gif.encode_samples(bytes(range(256)) * 9)
    odd = [(1, media), (2, None), (3, b"GIF89a"), (4, b"nothing"), (5, b"GIF89a\xff\xff\xff\xff\0\0\0" + media[13 + 768 :]), (6, media[:-40])]
    got = gif.gif_frames(spark.createDataFrame(odd, "key long, media binary"), "key", "media").collect()
    assert [r.frame for r in got if r.key == 1] == [0, 1, 2, 3] and all(sum(r.hist_red) == 576 for r in got if r.key == 1)
    assert all(r.error and r.frame is None for r in got if r.key > 1) and {r.key for r in got} == {1, 2, 3, 4, 5, 6}


def test_gif_streams_that_end_early_give_no_frames(spark):
    """One code for a whole frame, and a bad code in a later frame: an error row and nothing else."""
    media = gif.encode_samples(bytes(range(256)) * 9)
    short = gif._pack_codes([[256, 7, 257]])[0]
    at = media.rindex(b"\x2c")  # the last frame's descriptor may hold this byte too: build the file anew
    head = media[: 13 + 768]
    frame = lambda data: b"\x2c" + b"\0\0\0\0\x18\0\x18\0\0\x08" + bytes([len(data)]) + data + b"\0"
    whole = gif._pack_codes([gif._lzw_codes(bytes(576))])[0]
    bad = gif._pack_codes([[256, 7, 300, 257]])[0]
    odd = [(1, head + frame(whole) + b"\x3b"), (2, head + frame(short) + b"\x3b"), (3, head + frame(whole) + frame(short) + b"\x3b"), (4, head + frame(whole) + frame(bad) + b"\x3b")]
    got = gif.gif_frames(spark.createDataFrame(odd, "key long, media binary"), "key", "media").collect()
    assert at > 0 and sorted((r.key, r.frame, bool(r.error)) for r in got if r.key == 1) == [(1, 0, False)]
    assert sorted((r.key, r.frame, bool(r.error)) for r in got if r.key > 1) == [(2, None, True), (3, None, True), (4, None, True)]
    small = gif.gif_frames(spark.createDataFrame(odd[:1], "key long, media binary"), "key", "media", most_pixels=100).collect()
    assert len(small) == 1 and "24 x 24" in small[0].error


def test_frames_of_a_column_come_in_batches_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(gif, "HELD", 5_000)
    media = gif.encode_samples(os.urandom(576 * 40))
    got = gif.gif_frames(spark.createDataFrame([(1, media), (2, None), (3, media)], "key long, media binary"), "key", "media").collect()
    assert sorted((r.key, r.frame) for r in got if r.frame is not None) == [(k, i) for k in (1, 3) for i in range(40)] and len(got) == 81


def test_slices_of_keys_follow_the_keys():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        keys = np.sort(rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, n, dtype=np.uint64))
        for shards in (1, 2, 7, 10, 1000, 50_000_000):
            used, cut = blocks.shard_slices(keys, shards)
            assert [(int(k) * shards) >> 64 for k in keys] == np.repeat(used, np.diff(cut)).tolist() and len(used) <= max(n, 1) and len(cut) == len(used) + 1


def test_a_hub_of_many_neighbours(spark):
    from tesselon.llm import components

    n = 100_000
    star = spark.range(1, n + 1).selectExpr("id as u", "0L as v")
    chain = spark.range(n + 1, n + 41).selectExpr("id as u", "id + 1 as v")
    got = components.components(star.union(chain)).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: n, n + 1: 40}


# ---------------------------------------------------------------- shards and packs against plain Python


def hilbert(axes, bits):
    """Skilling's transform of coordinates to the curve's index."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def test_hilbert_shards_equal_brute_force(spark):
    random.seed(31)
    rows = [(random.randint(0, 300), random.choice([None, "", "é" * 9, prose(random.randint(1, 60))]), random.choice([None, "en", "de", "fr"]), random.choice([f"src{i}" for i in range(9)])) for _ in range(200)]
    docs = spark.createDataFrame([*rows, (None, "x", "en", "src1")], "doc_id long, text string, lang string, source string").repartition(4)

    def cells(values):
        known = sorted(x for x in values if x is not None)
        rank = {v: i for i, v in enumerate(sorted(set(known)))}
        table = spark.createDataFrame([(rank[v],) for v in known], "x long")
        limits = sorted({sorted(rank)[i] for i in table.agg(F.percentile_approx("x", [k / 31 for k in range(1, 31)], 1550)).first()[0]})
        return {v: 1 + sum(y < v for y in limits) * 30 // len(limits) for v in known} | {None: 0}

    size = lambda t: len((t or "").encode()) + 1
    lang, source, sizes_ = cells([r[2] for r in rows]), cells([r[3] for r in rows]), cells([size(r[1]) for r in rows])
    keyed = []
    for d, t, a, s in rows:
        raw = (t or "").encode()
        keyed.append((hilbert((source[s], lang[a], sizes_[len(raw) + 1]), 5), d, zlib.crc32(raw), len(raw) + 1))
    keyed.sort()
    got = sorted(((r.shard, r.slot), (r.curve, r.doc_id, r.text_crc32, r.size)) for r in shards.hilbert_shards(docs, 16).collect())
    assert [x for _, x in got] == keyed
    sizes = collections.Counter(s for (s, _), _ in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all([slot for (x, slot), _ in got if x == s] == list(range(n)) for s, n in sizes.items())


def test_shards_are_narrow_in_every_dimension(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = shards.hilbert_shards(docs, 16).select("doc_id", "shard").join(docs.select("doc_id", "lang", "source"), "doc_id")
    ends = placed.groupBy("shard").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max)]).collect()
    read = lambda c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in ends)
    mean = {c: np.mean([read(c, r[0]) for r in docs.select(c).distinct().collect()]) for c in ("lang", "source")}
    print(mean)
    assert mean["lang"] < 8.5 and mean["source"] < 8


def plain_packs(lengths, size):
    """Longest first, each piece into the emptiest pack that is open and has room for it."""
    packs = []
    for x in sorted(lengths, reverse=True):
        room, k = max(((size - sum(p), i) for i, p in enumerate(packs)), default=(0, 0))
        if room >= x:
            packs[k].append(x)
        else:
            packs.append([x])
    return packs


def test_packs_equal_plain_placement():
    random.seed(5)
    for size in (8, 50, 64):
        for _ in range(60):
            lengths = [random.randint(1, size) for _ in range(random.randint(1, 120))]
            have = packing.pack_histogram(dict(collections.Counter(lengths)), size)
            want = plain_packs(lengths, size)
            assert collections.Counter(x for c, xs in have for x in xs * c) == collections.Counter(lengths)
            assert sum(c for c, _ in have) <= 1.05 * len(want) + 1 and all(sum(xs) <= size for _, xs in have)


def test_suffix_sort_spills_and_recurses(spark, docs, monkeypatch):
    """A shard larger than the sort's memory: queues go to disk, recursion goes on until all ranks differ, results stay the same."""
    spilled, sizes = [], []
    close, sort = induced.Queues.close, induced.suffix_array
    monkeypatch.setattr(induced.Queues, "close", lambda q: (spilled.append(q.spilled), close(q))[1])
    monkeypatch.setattr(induced, "suffix_array", lambda text, *a: (sizes.append(len(text)), sort(text, *a))[1])
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh ") for _ in range(9)) for _ in range(60)]
    texts = list({"".join(rnd.choice(words) for _ in range(rnd.randint(8, 200))).encode() for _ in range(120)})
    low = np.array([rnd.randint(0, 99) for _ in texts])
    few = suffixes.window_minima(texts, low, 50, memory=700)
    assert max(spilled) > 10_000 and len(sizes) >= 3 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:]))
    assert all((a == b).all() for a, b in zip(few, suffixes.window_minima(texts, low, 50)))
    rows = lambda m: sorted(map(tuple, suffixes.dedup_suffixes(docs, memory=m).collect()))
    assert rows(500) == rows(None)


def test_long_chains_of_induced_suffixes_are_ranked_in_few_rounds(monkeypatch):
    """Two chains with the same symbols, whose order is that of their origins."""
    n = 2000
    symbol = np.array([5, 3] + [7 + i % 11 for i in range(n) for _ in range(2)])
    parents = np.array([-1, -1] + list(range(2 * n)), dtype=np.int32)
    sort, entries = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (entries.append(len(x)), sort(x, *a, **k))[1])
    got = induced._ranked(symbol, parents, np.zeros(len(symbol), dtype=bool))
    assert sum(entries) < 40 * len(symbol)
    place = {e: i for i, e in enumerate(got.tolist())}
    assert [place[1], place[0]] == [0, 1] and all(place[e] > place[e + 1] for e in range(2, len(symbol), 2))
    assert (np.diff(symbol[got]) >= 0).all()


def test_only_texts_with_a_repeated_window_are_sorted():
    one, two = bytes(range(60)), bytes(range(100, 160))
    texts = [one, two, b"xy" + two[:52], one[5:54] + b"z", b"q" * 50, b"r" * 51]
    assert suffixes._with_twins(texts, 50).tolist() == [1, 2, 5]


def test_suffix_array_of_large_alphabets_and_runs():
    rnd = random.Random(4)
    for kinds, n in ((2, 3000), (700, 5000), (50_000, 30_000)):
        t = np.array([rnd.randrange(kinds) for _ in range(n)], dtype=np.int32)
        t[n // 3 : n // 2] = kinds // 2
        want = sorted(range(n), key=lambda i: t[i : i + 400].tolist()) if kinds > 2 else None
        got = induced.suffix_array(t, kinds, rnd.choice((300, 10**6)))
        if want is None:
            raw = t.astype(np.uint8).tobytes()
            want = sorted(range(n), key=lambda i: raw[i:])
            assert got.tolist() == want
        else:
            assert sorted(got.tolist()) == list(range(n)) and all(t[a : a + 400].tolist() <= t[b : b + 400].tolist() for a, b in zip(got[:-1].tolist(), got[1:].tolist()))


def test_url_rules_by_pattern_and_by_join(spark):
    assert urls.literal_tokens(r"^(?:[^/]*\.)?shop\.com/a/(b|c)") == ("u:com", "u:a") and urls.literal_tokens("^ads") == () and urls.literal_tokens("(?i)^x/y/") == ()
    rules = [urls.prefix_rule(*r) for r in queries.URL_RULES] + [urls.regex_rule("block", r"(?:[^/]*\.)?shop\.com/a/[0-9]+"), urls.regex_rule("allow", r".*\.gif$")]
    seen = ["https://A.Example.com/en/70?x", "http://com/en/", "http://xcom/en/", None, "nourl", "ftp://example.net/de/8#a", "http://w.shop.com/a/77/b", "http://shop.com/a/x", "http://q.org/pic.gif", "http://b.com/en/" + "x" * 100_000, "http://b.com/en/" + "x" * 100_000, "://"]
    pages = spark.createDataFrame([(i % 5, u, "r", "h") for i, u in enumerate(seen)], "page_id long, url string, rule string, host string")
    rows = lambda d: sorted(map(str, d.collect()))
    plain = rows(urls.judge_urls(pages, rules))
    assert plain == rows(urls.judge_urls(pages, rules, most=2)) and len(plain) == len(seen)
    brute = []
    for i, u in enumerate(seen):
        host, path = urls._parts(u)
        fit = [r for r in rules if host and re.match(r.pattern, host + path)]
        best = max(fit, key=lambda r: (len(r.text), r.text), default=None)
        brute.append(str(type(pages.first())(page_id=i % 5, host=host, path=path, rule=best and best.text, verdict=best.verdict if best else "allow")))
    assert plain == sorted(brute) and sum("gif" in x for x in plain) and sum("block" in x for x in plain) == 5
    assert urls.judge_urls(pages.where("false"), rules).count() == 0 and {r.verdict for r in urls.judge_urls(pages, []).collect()} == {"allow"}


def test_shards_are_written_and_pruned(spark, tmp_path):
    rows = [(i, "t" * (1 + (i * 37) % 5000), ["en", "de", "fr", "es"][i % 4], f"s{i % 9}", "x") for i in range(800)] + [(5, "same", "en", "s1", "x")] * 3 + [(None, "no", "en", "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot string")
    shards.write_shards(docs, f"{tmp_path}/out", 8)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text, r.slot) for r in back) == sorted((r[0], r[1], r[4]) for r in rows if r[0] is not None)
    sizes = collections.Counter(r["shard"] for r in back)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    touched = lambda key: sum(len({r["shard"] for r in back if key(r) == k}) for k in {key(r) for r in back}) / len({key(r) for r in back})
    # a filter on any of the three dimensions reads fewer shards than all, on average
    assert touched(lambda r: r.source) < 6 and touched(lambda r: r.lang) < 8 and touched(lambda r: len(r.text).bit_length()) < 8


def test_near_duplicates_in_tiles(spark, monkeypatch):
    """A bucket of many members in several components, cut into tiles, gives the same components."""
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rnd.sample(range(160), 1 + i % 4):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(docs, percent=85).collect()))
    monkeypatch.setattr(minhash, "TILE", 7)
    assert sorted(map(tuple, minhash.near_duplicates(docs, percent=85).collect())) == want
