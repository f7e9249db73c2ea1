"""Streams over several batches, batches that are run again, the two-phase sink, percentiles by ranges, grounding and report files."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tesselon.operators import grounding, service, webhooks
from tesselon.sources import bulk, dicom, loaders
from tesselon.streaming import lifetimes, streams

random.seed(17)


def test_a_key_expires_and_returns(spark, tmp_path):
    minutes = lambda *xs: [(k, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00") for k, m in xs]
    batches = [minutes((1, 0), (1, 5), (2, 10)), minutes((2, 15), (3, 200)), minutes((1, 210), (4, 20), (3, 205)), minutes((3, 500))]
    path = f"file://{tmp_path}"
    with lifetimes.rocks_state(spark):
        for rows in batches:  # (4, 20) comes when the watermark is at 190 minutes: it is dropped
            df = spark.createDataFrame(rows, "k long, ts string").select("k", F.to_timestamp("ts").alias("ts"))
            df.write.mode("append").parquet(f"{path}/in")
            done = streams.run_to_end(lifetimes.lifetimes(streams.event_stream(spark, f"{path}/in", "k long, ts timestamp"), "k", 60 * 60_000), path)
    base = 1704067200000
    got = sorted((r.k, r.n, (r.first_ms - base) // 60_000, (r.last_ms - base) // 60_000) for r in done.collect())
    assert got == [(1, 1, 210, 210), (1, 2, 0, 5), (2, 2, 10, 15), (3, 2, 200, 205)]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_a_run_is_told_when_the_watermark_has_passed_it_and_not_by_its_next_event(spark, tmp_path):
    from tesselon.plans import surface

    end, life = 1704067200000, 43_200_000
    times = [(1, 0, end - life - 300_000), (2, 0, end), (3, 1, end - life - 600_001), (4, 2, end - life - 600_000), (5, 3, end - 3 * life), (6, 3, end - life), (8, 4, end - 4 * life), (9, 4, end - 4 * life + life)]
    times += [(7, 5, end + 60_000), (57, 2, end - 5), (107, 1, end - 700_000)]  # late ones; the last is dropped
    rows = spark.createDataFrame(times, "event_id long, user_id long, ms long").select("event_id", "user_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in surface.stream_lifetimes(spark, str(tmp_path)).collect())
    assert got == [(1, 1, end - life - 600_001, end - life - 600_001, 1), (3, 1, end - 3 * life, end - 3 * life, 1), (4, 2, end - 4 * life, end - 3 * life, 1)]
    assert lifetimes.runs_of([(1, 30, 30), (2, 0, 5), (1, 12, 12)], 8) == [(3, 0, 12), (1, 30, 30)]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    one, two = spark.range(5), spark.range(5, 8)
    for df, n in ((one, 0), (two, 1), (two, 1), (one, 0)):
        streams.write_once(df, out, n)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    # a stream whose last batch was written but not recorded as done writes it again when it starts anew
    schema, state = "id long", f"{tmp_path}/state"
    for half in (one, two):
        half.write.mode("append").parquet(f"file://{tmp_path}/in")
        for again in range(2):
            run = streams.ingest_once(streams.event_stream(spark, f"file://{tmp_path}/in", schema), f"file://{tmp_path}/twice", f"file://{state}")
            run.processAllAvailable()
            run.stop()
            last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
            if not again:
                for name in (str(last), f".{last}.crc"):
                    if os.path.exists(f"{state}/commits/{name}"):
                        os.remove(f"{state}/commits/{name}")
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/twice").collect()) == list(range(8))


# ---------------------------------------------------------------- the two-phase sink


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bulk.register(spark)
    path, schema = f"file://{tmp_path}/store", "id long, t string, xs array<int>"
    rows = [(i, random.choice([None, "é\n\"x", ""]), [i, i]) for i in range(50)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    put = lambda d, mode="append": d.write.format(bulk.NAME).option("path", path).mode(mode).save()
    back = lambda: sorted((r.id, r.t, list(r.xs)) for r in spark.read.format(bulk.NAME).schema(schema).option("path", path).load().collect())
    put(df)
    assert back() == rows
    bad = df.withColumn("t", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        put(bad)
    assert back() == rows and not [x for x in os.listdir(f"{tmp_path}/store") if x.startswith("staged")]
    put(df.where("id < 3"))
    assert len(back()) == 53
    put(df.where("id >= 48"), "overwrite")
    assert back() == rows[48:]
    put(df.where("false"), "overwrite")
    assert back() == []


def test_a_changed_file_is_refused(spark, tmp_path):
    bulk.register(spark)
    path = f"{tmp_path}/store"
    spark.range(10).coalesce(1).write.format(bulk.NAME).option("path", path).mode("append").save()
    name = bulk.published(path)[0]["file"]
    with open(f"{path}/{name}", "ab") as f:
        f.write(b'{"id": 99}\n')
    with pytest.raises(Exception, match="as it was published"):
        spark.read.format(bulk.NAME).schema("id long").option("path", path).load().collect()


def test_a_task_that_is_run_twice_counts_once(tmp_path):
    """Two attempts of a task stage their rows; the commit knows only the message of one."""
    writer = bulk.BulkWriter(f"{tmp_path}", ["id"], False)
    first, second, other = writer.write(iter([{"id": 1}])), writer.write(iter([{"id": 1}])), writer.write(iter([]))
    writer.commit([second, other, None])
    assert first.file != second.file and [(f["file"], f["rows"]) for f in bulk.published(f"{tmp_path}")] == [(second.file, 1)]
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith("version")) == [second.file]


# ---------------------------------------------------------------- webhooks


def test_signatures_equal_the_library(spark):
    import hmac

    for secret in ("", "s", "é" * 20, "k" * 64, "k" * 65, "long " * 50):
        hooks = webhooks.configure(spark, [("https://a.example/x", ["b", "a", "a"], secret)])
        events = spark.createDataFrame([(1, "a", "t", {"k": "é\"x"}), (2, "c", "t", {}), (3, "b", None, None)], "event_id long, event string, timestamp string, data map<string,string>")
        got = webhooks.payloads(events, hooks).collect()
        assert sorted(r.event_id for r in got) == [1, 3] and len({r.delivery_id for r in got}) == 2
        assert all(r.signature == hmac.new(secret.encode(), r.body.encode(), "sha256").hexdigest() for r in got)
    with pytest.raises(ValueError):
        webhooks.configure(spark, [("ftp://a", ["a"], "s")])


def test_deliveries_are_tried_again(spark):
    def make():
        seen = {}

        def client(url, body, headers):
            seen[headers["X-Delivery"]] = n = seen.get(headers["X-Delivery"], 0) + 1
            if "down" in url:
                raise OSError("no route")
            return 500 if "slow" in url and n < 3 else 404 if "gone" in url else 204

        return client

    hooks = webhooks.configure(spark, [(f"https://{n}.example", ["a"], "s") for n in ("down", "slow", "gone", "fine")])
    events = spark.createDataFrame([(1, "a", "t", {"k": "v"})], "event_id long, event string, timestamp string, data map<string,string>")
    sent = webhooks.payloads(events, hooks)
    names = {r.delivery_id: r.url.split("/")[2].split(".")[0] for r in sent.collect()}
    got = {names[r.delivery_id]: (r.attempts, r.status, r.error) for r in webhooks.deliver(sent, make, wait=0.0).collect()}
    assert got == {"down": (3, None, "no route"), "slow": (3, 204, None), "gone": (3, 404, None), "fine": (1, 204, None)}


# ---------------------------------------------------------------- percentiles


@pytest.mark.parametrize("piece", [7, 200_000])
def test_percentiles_equal_sorting(spark, monkeypatch, piece):
    import numpy as np

    monkeypatch.setattr(service, "PIECE", piece)
    monkeypatch.setattr(service, "PIECES", 6)
    rows = [("a", float(random.randint(0, 400))) for _ in range(900)] + [("b", 5.0)] * 40 + [("c", x / 7) for x in range(3)] + [("d", None)] + [("e", float(x)) for x in [1] * 300 + list(range(300))] + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.k: (r.low, r.p50, r.p95, round(r.p99, 9)) for r in service.percentiles(df.where("k is not null"), ["k"], "v", shares, between=("p99",)).collect()}
    want = {}
    for k in "abce":
        x = sorted(v for j, v in rows if j == k)
        want[k] = (x[0], x[int(0.5 * len(x))], x[int(0.95 * len(x))], round(float(np.quantile(x, 0.99)), 9))
    assert got == want
    every = sorted(v for _, v in rows if v is not None)
    assert service.percentiles(df, [], "v", {"p": 0.95}).collect()[0].p == every[int(0.95 * len(every))]
    assert service.percentiles(df.where("false"), ["k"], "v", shares).count() == 0


def test_pages(spark):
    df = spark.range(95)
    first = service.page(df, ["id"], 1, 20).collect()
    assert len(first) == 20 and (first[0].total, first[0].pages, first[0].has_next, first[0].has_prev) == (95, 5, True, False)
    last = service.page(df, ["id"], 5, 20).collect()
    assert len(last) == 15 and (last[0].has_next, last[0].has_prev) == (False, True)
    assert service.page(df.limit(40), ["id"], 2, 20).first().pages == 2 and service.page(df, ["id"], 9, 20).count() == 0


# ---------------------------------------------------------------- grounding


@pytest.mark.parametrize("most", [3, 500_000])
def test_terms_that_the_context_lacks(spark, monkeypatch, most):
    monkeypatch.setattr(grounding, "TERMS", most)
    terms = spark.createDataFrame([(x,) for x in ["Aspirin", "beta blocker", "blocker", "as", None, "", "insulin glargine", "ACE"]], "term string")
    rows = [(1, "Give aspirin 81 mg and a Beta  Blocker.", "81 mg of ASPIRIN"), (2, "aspirins, assets", "x"), (3, None, "ace"), (4, "7.5 of insulin-glargine, 3", None), (5, "blocker", "beta blocker")]
    got = {r.k: (r.numbers, r.terms, r.grounded) for r in grounding.ungrounded(spark.createDataFrame(rows, "k int, text string, before string"), ["k"], terms).collect()}
    assert got == {1: ([], ["beta blocker", "blocker"], False), 2: ([], [], True), 3: ([], [], True), 4: (["3", "7.5"], ["insulin glargine"], False), 5: ([], [], True)}


# ---------------------------------------------------------------- report files


@pytest.mark.parametrize("syntax", [dicom.IMPLICIT, "1.2.840.10008.1.2.1", dicom.BIG, dicom.DEFLATED])
@pytest.mark.parametrize("open_end", [False, True])
def test_report_files(syntax, open_end):
    header = {"patient_id": "p1", "modality": "SR", "study_description": "chest é", "series_description": "s"}
    lines = ["finding one", "日本 ", "", "x" * 70_001]
    assert dicom.read(dicom.report(header, lines, syntax, open_end)) == (header, "finding one\n日本\n\n" + "x" * 70_001 + "\n")
    assert dicom.read(dicom.report(header, None, syntax))[1] == "[DICOM study: chest é]"


def test_broken_report_files(spark):
    whole = dicom.report({"patient_id": "p1"}, ["a" * 300, "b"], "1.2.840.10008.1.2.1")
    cut = [whole[:n] for n in range(0, len(whole), 7)]
    deep = b"".join(struct.pack("<HH", 0x40, 0xA730) + b"SQ\0\0" + struct.pack("<IHHI", 0xFFFFFFFF, 0xFFFE, 0xE000, 0xFFFFFFFF) for _ in range(500))
    files = [(f"/x/{i}.dcm", x) for i, x in enumerate([*cut, whole[: 132 + 28] + deep, b"", None])]
    got = loaders.binary_contents(spark.createDataFrame(files, "path string, content binary")).collect()
    assert len(got) == len(files) and sum(r.load_error is not None for r in got) >= len(cut) // 2
    with pytest.raises(ValueError):
        dicom.read(whole[: 132 + 28] + deep)
