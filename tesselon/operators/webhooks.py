"""Events delivered to subscribed addresses: who gets what, signed payloads, and delivery by an injected client.

A hook is an address, the names of the events that it wants, and a secret.  Events meet hooks by name, payloads and
signatures (HMAC-SHA256 of the body) are built by expressions: a key's two pads are made once a hook.  A delivery's id
follows from hook and event alone, so a receiver knows one that a task which ran again has sent before.  The client is made
once a task; a delivery that fails is tried again after 1, 2, 4 .. times ``wait`` and then told with its last error.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOOKS = 10_000  # subscriptions that may be broadcast


def pads(secret: str) -> tuple[bytes, bytes]:
    """The two blocks that HMAC puts before what it hashes."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def webhook_id(url: str, events: list[str]) -> str:
    return "wh_" + hashlib.sha256("|".join([url, *sorted(set(events))]).encode()).hexdigest()[:12]


def configure(spark: SparkSession, hooks: list[tuple[str, list[str], str]]) -> DataFrame:
    """webhook_id, url, event, inner, outer: a row a subscription of (url, events, secret); an address must be http or https."""
    rows = []
    for url, events, secret in hooks:
        if not url.startswith(("https://", "http://")):
            raise ValueError(f"not an address: {url}")
        rows += [(webhook_id(url, events), url, e, *map(bytearray, pads(secret))) for e in sorted(set(events))]
    return spark.createDataFrame(rows, "webhook_id string, url string, event string, inner binary, outer binary")


def payloads(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """delivery_id, webhook_id, url, event_id, body, signature for events (event_id, event, timestamp, data: a struct or a map)."""
    few = F.broadcast(subscriptions) if subscriptions.count() <= HOOKS else subscriptions
    sent = events.join(few, "event").withColumn("body", F.to_json(F.struct("event", "timestamp", "data")))
    inner = F.unhex(F.sha2(F.concat("inner", F.encode("body", "UTF-8")), 256))
    delivery = F.sha2(F.concat_ws("|", "webhook_id", F.col("event_id").cast("string")), 256)
    return sent.select(delivery.alias("delivery_id"), "webhook_id", "url", "event_id", "body", F.sha2(F.concat("outer", inner), 256).alias("signature"))


def deliver(sent: DataFrame, make: Callable[[], Callable], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """delivery_id, webhook_id, event_id, attempts, status, error; ``make()`` gives client(url, body, headers) -> status, 200 to 299 for success."""

    def run(batches):
        import pyarrow as pa

        client = make()

        def post(url, body, headers):
            status = error = None
            for n in range(1, attempts + 1):
                try:
                    status, error = int(client(url, body, headers)), None
                except Exception as e:  # an address that can't be reached is told, not fatal
                    status, error = None, str(e)
                if status is not None and 200 <= status < 300:
                    break
                if n < attempts:
                    time.sleep(wait * 2 ** (n - 1))
            return n, status, error

        for b in batches:
            rows = [post(u, body, {"X-Delivery": d, "X-Signature": f"sha256={s}"}) for d, u, body, s in zip(*(b.column(c).to_pylist() for c in ("delivery_id", "url", "body", "signature")))]
            kinds = (pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("delivery_id"), b.column("webhook_id"), b.column("event_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["delivery_id", "webhook_id", "event_id", "attempts", "status", "error"])

    kind = sent.schema["event_id"].dataType.simpleString()
    return sent.mapInArrow(run, f"delivery_id string, webhook_id string, event_id {kind}, attempts int, status int, error string")
