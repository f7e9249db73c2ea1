"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the word classes of a clause: insult (bare, after an intensifier, or
piled upon another), threat (an intent, a threat word, then whom it is aimed at), target
(second and third person), negation and reported speech.  They are composed into one
automaton whose states are tuples of theirs; running it over a clause gives matched
patterns (insults and threats, each bare, targeted, negated or reported), each with the
weight of its word.  Clauses are scored, not single words: the same word adds to another
feature if its clause negates or reports it.  Quotes hold over clauses until they are
closed, at most to the end of the line; a colon does not end a clause.  A logistic model
over the pattern features, fitted on the labelled training rows, gives the score.

The insult lexicon begins with the ``INSULTS`` (at one weight, unless the labels speak
against a word) and is extended from the labelled training rows by words and word
beginnings (4 to 6 letters, for inflected languages; not where one word makes up 80 % of a
beginning): those that occur in at least 3 % of toxic documents and, at two standard
deviations below the count, 20 times as often as in others; weight is the log ratio.  At
most ``FIT_ROWS`` labelled rows are used for both fits (chosen by hash of the doc_id);
their number is the only bound, and scoring covers all documents and whole texts.

A null or empty text matches nothing and gets the score of such documents; texts of any
length are read whole.  ``score`` leaves out rows without doc_id, ``reject`` judges them
too; other columns play no part, whatever their names.  Repeated rows are scored alike; an
empty table gives an empty result, and a model fitted without labelled rows rejects nothing.
Labels are used only where crc32(doc_id as text) mod 4 is not 2.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts_of, tidy

FIT_ROWS = 12_000
THRESHOLD = 0.3

# Closed word classes in English, German, French and Spanish (chosen for this library).
TARGETS = "you your yours yourself u ye he she they them him her du dich dir dein deine ihr euch sie ihn tu te toi ton ta vous votre lui elle eux tú ti usted ustedes él ella ellos"
NEGATIONS = "not no never none neither nor isn't aren't don't doesn't wasn't cannot won't nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna"
REPORTS = "said says say told tells claimed claims called calls quoted wrote writes sagte sagt behauptete schrieb dit disait écrit affirme dijo dice escribió afirma"
THREATS = "kill hurt destroy beat smash attack burn töten schlagen vernichten tuer frapper détruire matar golpear destruir"
INTENTS = "will shall gonna going i'll we'll won't werde werden vais allons voy vamos"
INTENSIFIERS = "so such complete total utter absolute really totally fucking damn echt völlig wirklich tellement vraiment complètement tan totalmente realmente"
INSULTS = "idiot idiots moron morons loser losers scum clown stupid disgusting worthless pathetic trash imbecile jerk dumbass dummkopf trottel versager abschaum imbécile crétin abruti imbécil estúpido idiota"
SEED_WEIGHT = 3.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;,\n]+|[:\"“”«»]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, QUOTE, INTENSE = range(9)
_QUOTES = frozenset('"“”«»')
FEATURES = ("bare", "targeted", "negated", "reported", "threat", "negated_threat", "reported_threat")
STRONG = 1.5


# ---------------------------------------------------------------- the grammar


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, word class) -> (state, mark)."""

    name: str
    start: int
    step: object = field(compare=False)


def _negation(state: int, c: int):
    """A negation holds for the three words after it."""
    return (3 if c == NEGATION else max(state - 1, 0)), "negated" if state else None


def _report(state: int, c: int):
    """Bit 1: a word of reporting, to the end of the clause.  Bit 2: inside quotes."""
    now = state | 1 if c == REPORT else state ^ 2 if c == QUOTE else state
    return now, "reported" if state else None


def _target(state: int, c: int):
    return (1 if c == TARGET else state), "targeted" if state else None


def _insult(state: int, c: int):
    """0: nothing; 1, 2: words since an intensifier; 3: an insult stands in the clause already."""
    if c == INSULT:
        return 3, "strong insult" if state else "insult"
    if state == 3:
        return 3, None
    return (2 if c == INTENSE else max(state - 1, 0)), None


def _threat(state: int, c: int):
    """1 to 4: words left for a threat word after an intent; 11 to 13: words left for its target."""
    if state > 10:
        return (0, "threat") if c == TARGET else ((state - 1) if state > 11 else 0, None)
    if state and c == THREAT:
        return 13, None
    return (4 if c == INTENT else max(state - 1, 0)), None


MACHINES = tuple(Transducer(n, 0, f) for n, f in (("insult", _insult), ("threat", _threat), ("target", _target), ("negation", _negation), ("report", _report)))


def compose(machines=MACHINES) -> list[list[tuple[int, int, float]]]:
    """One automaton for all machines: table[state][class] = (state, feature number or -1, factor)."""
    first = tuple(m.start for m in machines)
    number, table, todo = {first: 0}, [], [first]
    for states in todo:  # grows while it is read
        row = []
        for c in range(9):
            moved = [m.step(s, c) for m, s in zip(machines, states)]
            marks = {x for _, x in moved if x}
            nxt = tuple(s for s, _ in moved)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            f, factor = None, STRONG if "strong insult" in marks else 1.0
            if "threat" in marks:
                f = next((f"{x}_threat" for x in ("negated", "reported") if x in marks), "threat")
            elif "insult" in marks or "strong insult" in marks:
                f = next((x for x in ("negated", "reported", "targeted") if x in marks), "bare")
            row.append((number[nxt], FEATURES.index(f) if f else -1, factor))
        table.append(row)
    return table


class Grammar:
    """The composed automaton with a lexicon: word or beginning (``lowei*``) -> weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.table = compose()
        self.words = {w: x for w, x in lexicon.items() if w[-1] != "*"}
        self.starts = {w[:-1]: x for w, x in lexicon.items() if w[-1] == "*"}
        self.sizes = sorted({len(w) for w in self.starts})
        self.closed = {w: c for c, ws in ((TARGET, TARGETS), (REPORT, REPORTS), (THREAT, THREATS), (INTENT, INTENTS), (INTENSE, INTENSIFIERS), (NEGATION, NEGATIONS)) for w in ws.split()}
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        x = self.cache.get(word)
        if x is None:
            x = max([self.words.get(word, 0.0), *(self.starts.get(word[:n], 0.0) for n in self.sizes if len(word) >= n)])
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = x
        return x

    def features(self, text: str | None) -> list[float]:
        """Logarithms of the summed weights of the matched patterns, feature by feature."""
        sums = [0.0] * len(FEATURES)
        if text:
            clause: list[str] = []
            quoted = False
            for w in _WORD.findall(text.lower()):
                if w[0] not in ".!?;,\n":
                    clause.append(w)
                    continue
                if clause:
                    quoted = self._clause(clause, sums, quoted)
                    clause = []
                if quoted and "\n" in w:
                    quoted = False
            self._clause(clause, sums, quoted)
        return [math.log1p(x) for x in sums]

    def _clause(self, clause: list[str], sums: list[float], quoted: bool) -> bool:
        """Adds the clause's patterns; whether it ends inside quotes."""
        get, closed = self.cache.get, self.closed
        weights = [x if (x := get(w)) is not None else self.weight(w) for w in clause]
        if any(weights) or any(closed.get(w) == THREAT for w in clause):
            state = self.table[0][QUOTE][0] if quoted else 0
            for w, x in zip(clause, weights):
                c = INSULT if x else closed.get(w, OTHER)
                if w in _QUOTES:
                    quoted, before = (not quoted if w == '"' else w in "“«"), quoted
                    c = QUOTE if quoted != before else OTHER
                state, f, factor = self.table[state][c]
                if f >= 0:
                    sums[f] += (x or 1.0) * factor
            return quoted
        for w in _QUOTES & set(clause) if not _QUOTES.isdisjoint(clause) else ():
            quoted = (quoted ^ bool(clause.count(w) % 2)) if w == '"' else quoted
        if not _QUOTES.isdisjoint(clause):
            turned = [w for w in clause if w in "“”«»"]
            quoted = turned[-1] in "“«" if turned else quoted
        return quoted


# ---------------------------------------------------------------- fitting


def _candidates(text: str | None) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in range(4, 7) if len(w) > n}


def _count(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(_candidates(t) if wanted is None else _candidates(t) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["item", "n"])

    return rows.select("text").mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))


def fit_lexicon(sample: DataFrame) -> dict[str, float]:
    """sample: text, toxic.  Collected are only items frequent in toxic rows."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return {}
    seeds = frozenset(INSULTS.split())
    seen = {toxic: {r["item"]: r["n"] for r in _count(sample.where(F.col("toxic") == toxic), seeds).collect()} for toxic in (0, 1)}
    doubtful = lambda w: seen[0].get(w, 0) >= 3 and seen[1].get(w, 0) / n1 < 2 * seen[0][w] / max(n0, 1)
    known = {w: SEED_WEIGHT for w in seeds if not doubtful(w)}
    least = max(3, 0.03 * n1)
    hot = {r["item"]: r["n"] for r in _count(sample.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    cold = {r["item"]: r["n"] for r in _count(sample.where("toxic = 0"), frozenset(hot)).collect()}
    out = {}
    for w, k in hot.items():
        rare = math.log((cold.get(w, 0) + 0.5) / (n0 + 1))
        if math.log((max(k - 2 * math.sqrt(k), 0) + 0.5) / (n1 + 1)) - rare >= math.log(20):
            out[w] = round(math.log((k + 0.5) / (n1 + 1)) - rare, 6)
    whole = [w for w in out if w[-1] != "*"]
    explained = {b for b in out if b[-1] == "*" and any(w.startswith(b[:-1]) and hot[w] >= 0.8 * hot[b] for w in whole)}
    return known | {w: x for w, x in out.items() if w not in explained}


def fit_logistic(x, y):
    """Ridge-penalised logistic regression by Newton steps; the last coefficient is the constant."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    coefficients: list[float]


def held_out(doc_id) -> object:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    import numpy as np

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    n = marked.count()
    parts = 1_000_000
    some = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * min(1.0, fit_rows / max(n, 1))))
    small = n <= fit_rows or fit_rows <= 100_000  # the sample follows fit_rows, not the input
    sample = materialise(texts_of(docs).join(F.broadcast(some) if small else some, "doc_id").select("text", "toxic"), "labelled")
    lexicon = fit_lexicon(sample)

    def run(batches):
        import pyarrow as pa

        g = Grammar(lexicon)
        for b in batches:
            rows = [g.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = sorted((r["x"], r["y"]) for r in sample.mapInArrow(run, "x array<double>, y int").collect())
    if not got:
        return Model(lexicon, [0.0] * len(FEATURES) + [-5.0])
    return Model(lexicon, fit_logistic(np.array([x for x, _ in got]), np.array([y for _, y in got], dtype=float)))


class Judge:
    """(score, pattern features) of a text."""

    def __init__(self, model: Model):
        self.grammar, (*self.weights, self.bias) = Grammar(model.lexicon), model.coefficients

    def __call__(self, text: str | None) -> tuple[float, list[float]]:
        x = self.grammar.features(text)
        z = self.bias + sum(a * c for a, c in zip(self.weights, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), x


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic; all columns, whatever their names, and rows without doc_id are judged by their text alone."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        judge = Judge(model)
        for b in batches:
            kept = pa.array([judge(t)[0] < THRESHOLD for t in b.column(at).cast(pa.string()).to_pylist()], pa.bool_())
            yield b.filter(kept)
        del judge
        tidy()

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, patterns (feature values); a row for each row that has a doc_id."""

    def run(batches):
        import pyarrow as pa

        judge = Judge(model)
        for b in batches:
            found = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["doc_id", "score", "patterns"])

    out = texts_of(docs).mapInArrow(run, "doc_id long, score double, patterns array<double>")
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
