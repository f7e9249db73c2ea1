"""Models as injected callables: made once a task, applied to Arrow batches.  None is shipped with this library."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def apply(df: DataFrame, columns: list[str], out: str, kind: str, make: Callable[[], Callable]) -> DataFrame:
    """Adds ``out``: ``make()`` gives a function from lists of the columns' values to the list of results."""

    def run(batches):
        import pyarrow as pa

        model = make()
        target = None
        for b in batches:
            values = model(*[b.column(c).to_pylist() for c in columns])
            target = pa.array(values) if target is None else pa.array(values, type=target.type)
            yield pa.RecordBatch.from_arrays([*b.columns, target], [*b.schema.names, out])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {out} {kind}")


def encode(docs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """doc_id, text and vector, normalised by the model."""
    return apply(docs.select("doc_id", "text"), ["text"], "vector", "array<double>", make)


def cross_encode(pairs: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """Adds rerank_score to (question, text) pairs."""
    return apply(pairs, ["question", "text"], "rerank_score", "double", make)


def generate(prompts: DataFrame, make: Callable[[], Callable], attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Adds answer to user_message: a client that fails is asked again after 1, 2, 4 .. times ``wait``, then the error is the answer."""

    def with_retries():
        client = make()

        def one(message):
            for n in range(attempts):
                try:
                    return client(message)
                except Exception as e:
                    error = e
                    if n + 1 < attempts:
                        time.sleep(wait * 2**n)
            return f"[LLM Error: {error}]"

        return lambda messages: [one(m) for m in messages]

    return apply(prompts, ["user_message"], "answer", "string", with_retries)
