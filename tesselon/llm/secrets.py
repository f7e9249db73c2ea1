"""Secret scans: rules for assigned values, access keys and long hexadecimal strings, and two character Markov models.

The models are first-order chains over ASCII letters, digits and ``+/_-``: one of random strings, one of ordinary
identifiers.  A maximal run of at least ``LEAST`` of these characters, with a letter and ``DISTINCT`` different characters,
is a span of kind ``random`` if its log-likelihood ratio, random against ordinary, reaches ``ODDS`` (a million to one) and
``MEAN`` a transition (so that a long name of rare letters isn't one).
Spans that the rules find stay as they are; a run that touches one adds nothing.

Both chains are trained from labelled samples: the values that the rules find and that hold letter and digit are random,
all other runs of the corpus are ordinary; or, with ``fit_labelled``, from rows (value, secret) of any source.  Transitions
are counted over all documents, one table of 2 * 66 * 66 sums a task, so what reaches the driver is of fixed size.  Half
of each random transition is the uniform one over the alphabet, so that alphabets that no sample shows are known at any
size of the corpus; ordinary runs count as they stand, in capitals, and joined to the next one of their document as camel,
snake, kebab case and path, an eighth each; a character's transitions are smoothed
by one, dealt as characters follow any other.  Weights are whole thousandths, so a score doesn't depend on the batch.

A batch is read as one byte buffer: byte classes, runs and their scores are numpy over all rows; only rows in which a
pattern for all rules matches are searched rule by rule.  Start and end are code points of the whole text, whatever its
length.  A null text is empty.  Each row gives a row, repeated rows equal ones, a null doc_id too; an empty table none, and
a model without samples finds nothing.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .infill import slices, whole_texts

LEAST = 16
DISTINCT = 6
ODDS = 13_816  # thousandths of the natural logarithm of 1e6
MEAN = 2_000
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
N = len(ALPHABET)
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (("assign", re.compile(_ASSIGN, re.I), 2, 6), ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(rb"[0-9a-f]{24,}"), 0, 24))
_ANY = rf"(?i:{_ASSIGN.decode()})|AKIA[A-Z0-9]|[0-9a-f]{{24}}"
_MIXED = re.compile(rb"(?=.*[A-Za-z])(?=.*[0-9])", re.S)


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts) in bytes, sorted; leftmost and without overlaps within a kind."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), kind, m.end(), m.start(group)) for m in pattern.finditer(raw) if m.end(group) - m.start(group) >= least]
    return sorted(found)


# ---------------------------------------------------------------- runs of a batch


class Runs:
    """Runs of the alphabet in the texts of a batch; none crosses a text's end."""

    def __init__(self, texts):
        import numpy as np
        import pyarrow.compute as pc

        table = np.full(256, N, np.uint8)
        table[np.frombuffer(ALPHABET, np.uint8)] = np.arange(N)
        self.texts, self.flat, self.edges = whole_texts(texts)
        self.codes = table[self.flat]
        inside = self.codes < N
        first, last = self.edges[:-1], self.edges[1:]
        full = last > first
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        start[first[full]] = inside[first[full]]
        end[last[full] - 1] = inside[last[full] - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.pair = inside[:-1] & inside[1:] & ~start[1:]
        self.step = self.codes[:-1].astype(np.int32) * N + self.codes[1:]
        self.step[~self.pair] = 0
        suspects = np.flatnonzero(pc.match_substring_regex(self.texts, _ANY).to_numpy(zero_copy_only=False))
        self.base = {int(r): found for r in suspects if (found := base_spans(self.raw(r)))}

    def raw(self, row: int) -> bytes:
        return self.flat[self.edges[row] : self.edges[row + 1]].tobytes()

    def covered(self, values: bool = False):
        """Mask of the bytes in spans of the rules, or in those of their values that hold letter and digit."""
        import numpy as np

        mask = np.zeros(len(self.flat), bool)
        for row, found in self.base.items():
            at = self.edges[row]
            for start, _, end, value in found:
                if not values:
                    mask[at + start : at + end] = True
                elif _MIXED.match(self.flat[at + value : at + end].tobytes()):
                    mask[at + value : at + end] = True
        return mask


def _upper(codes):
    import numpy as np

    return np.where((codes >= 26) & (codes < 52), codes - 26, codes)


def count_steps(texts, secret=None):
    """(random, ordinary) counts of transitions in a batch, eight to a transition; ``secret`` labels whole rows, else the rules do."""
    import numpy as np

    r = Runs(texts)
    if not len(r.flat):
        return np.zeros((2, N * N), np.int64)
    if secret is not None:
        random = np.repeat(secret, np.diff(r.edges))
        other = ~random
    else:
        random, other = r.covered(values=True), ~r.covered()
    both = lambda m: r.pair & m[:-1] & m[1:]
    counts = [np.bincount(r.step[both(m)], minlength=N * N) * 8 for m in (random, other)]
    ordinary = counts[1].reshape(N, N)
    upper = _upper(np.arange(N))
    capitals = np.zeros((N, N), np.int64)
    np.add.at(capitals, (upper[:, None], upper[None, :]), ordinary)
    own = other[r.starts]
    row = np.searchsorted(r.edges, r.starts, "right")
    joined = own[:-1] & own[1:] & (row[:-1] == row[1:])
    ends, starts = r.codes[r.ends[:-1][joined] - 1].astype(np.int32), r.codes[r.starts[1:][joined]].astype(np.int32)
    joins = np.bincount(ends * N + _upper(starts), minlength=N * N)
    for sign in b"_-/":
        joins = joins + sum(np.bincount(x, minlength=N * N) for x in (ends * N + ALPHABET.index(sign), ALPHABET.index(sign) * N + starts))
    return np.stack([counts[0], (ordinary + capitals).ravel() + joins])


# ---------------------------------------------------------------- the models


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each transition, in thousandths, row by row."""

    weights: list[int]


def _model(counts: DataFrame) -> Model:
    import numpy as np

    c = np.zeros((2, N, N))
    for r in counts.groupBy("secret", "step").agg(F.sum("n").alias("n")).collect():  # 2 * 66 * 66 rows at most
        c[0 if r["secret"] else 1, r["step"] // N, r["step"] % N] = r["n"] / 8
    if not c[0].any() or not c[1].any():
        return Model([0] * (N * N))
    seen = c[0].sum(axis=1, keepdims=True)
    random = np.where(seen > 0, c[0] / np.maximum(seen, 1e-9), 1 / N) / 2 + 0.5 / N
    letters = (c[1].sum(axis=0) + 1 / N) / (c[1].sum() + 1)
    ordinary = (c[1] + letters) / (c[1].sum(axis=1, keepdims=True) + 1)
    return Model(np.rint(1000 * np.log(random / ordinary)).astype(int).ravel().tolist())


def _counted(rows: DataFrame, labelled: bool) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((2, N * N), np.int64)
        for whole in batches:
            for b in slices(whole, 0):
                total += count_steps(b.column(0), b.column(1).to_numpy(zero_copy_only=False) if labelled else None)
        kind, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 0), pa.array(step, pa.int32()), pa.array(total[kind, step], pa.int64())], ["secret", "step", "n"])

    return rows.mapInArrow(run, "secret boolean, step int, n long")


def fit(docs: DataFrame) -> Model:
    """Trained from all documents, labelled by the rules."""
    return _model(_counted(docs.select(F.col("text").cast("string").alias("text")), False))


def fit_labelled(samples: DataFrame) -> Model:
    """Trained from rows (value, secret); rows with a null are left out."""
    return _model(_counted(samples.where("value is not null and secret is not null").select(F.col("value").cast("string").alias("value"), F.col("secret").cast("boolean").alias("secret")), True))


def find_spans(texts, model: Model) -> list[list[dict]]:
    """For each text its spans (kind, start, end, score), in code points, by start and kind; score is the ratio of a random run."""
    import numpy as np

    r = Runs(texts)
    out: list[list[dict]] = [[] for _ in range(len(r.texts))]
    sums = np.concatenate(([0], np.cumsum(np.array(model.weights, np.int64)[r.step] * r.pair))) if len(r.flat) else np.zeros(1, np.int64)
    taken = np.concatenate(([0], np.cumsum(r.covered())))
    s, e = r.starts, r.ends
    score = sums[e - 1] - sums[s] if len(s) else s
    good = np.flatnonzero((e - s >= LEAST) & (score >= ODDS) & (score >= MEAN * (e - s - 1)) & (taken[e] == taken[s])) if len(s) else s
    letter = re.compile(rb"[A-Za-z]")
    found = {row: [(a, k, b, None) for a, k, b, _ in spans] for row, spans in r.base.items()}
    for i in good.tolist():
        run = r.flat[s[i] : e[i]].tobytes()
        if len(set(run)) >= DISTINCT and letter.search(run):
            row = int(np.searchsorted(r.edges, s[i], "right")) - 1
            found.setdefault(row, []).append((int(s[i] - r.edges[row]), 3, int(e[i] - r.edges[row]), int(score[i]) / 1000))
    for row, spans in found.items():
        chars = np.concatenate(([0], np.cumsum((r.flat[r.edges[row] : r.edges[row + 1]] & 0xC0) != 0x80)))
        out[row] = [{"kind": KINDS[k], "start": int(chars[a]), "end": int(chars[b]), "score": x} for a, k, b, x in sorted(spans, key=lambda x: x[:2])]
    return out


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) for each row."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(find_spans(b.column(1), model), span)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Digest of the scan with models trained on the documents themselves."""
    spans = F.col("spans")
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return scan(docs, fit(docs)).select("doc_id", *map(number, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
