"""URL rules indexed by their rarest literal token.

A rule is host plus path prefix (``net/de/`` holds for net and its subdomains, for paths
that begin with /de/) or any other regular expression over ``host + path``, whose literal
tokens are read off its parse tree: those that every match must hold.  Each rule is filed
under that of its literal tokens which occurs least often in the URLs at hand; the tokens
of a URL fetch candidate rules, and only those run their regular expression.  Rules without
a literal token are tried on every URL that has a host.  The longest matching rule wins;
where none matches the verdict is ``allow``.

Up to ``MAX_RULES`` rules travel with the tasks, compiled once in each Python worker;
beyond that the filed rules are a table that is joined with the tokens of the URLs.

A null url, or one without ``://``, has empty host and path and matches no rule.  Repeated
rows and page_ids give a row each, of rules of one length the greater text wins, urls of
any length are judged whole, other columns play no part, whatever their names; an empty
table or rule set gives an empty result or ``allow`` for all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def prefix_rule(verdict: str, text: str) -> Rule:
    """``host/path-prefix``; a token that the path prefix may cut short is not filed."""
    host, _, path = text.partition("/")
    cut = bool(path) and path[-1].isalnum()
    found = _TOKEN.findall(path)
    tokens = [f"h:{t}" for t in _TOKEN.findall(host)] + [f"p:{t}" for t in (found[:-1] if cut else found)]
    return Rule(text, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(tokens))


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of a pattern over host + path holds, as ``u:`` tokens (of either part)."""
    from re import _constants as op
    from re import _parser as parser

    def runs(parsed) -> list[str]:
        """The literal text that surely stands in a row; a blank marks where anything may stand."""
        out = []
        for kind, value in parsed:
            if kind is op.LITERAL:
                out.append(chr(value))
            elif kind is op.SUBPATTERN and not value[1]:
                out += runs(value[3])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                out += [*runs(value[2]), " "]
            elif kind is op.AT:
                out.append("" if value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING) and not out else " ")
            else:
                out.append(" ")
        return out

    parsed = parser.parse(pattern)
    if parsed.state.flags & re.I:
        return ()
    text = "".join(runs(parsed))
    begins = pattern.startswith(("^", "\\A"))
    found = []
    for m in _TOKEN.finditer(text):
        left = m.start() > 0 and text[m.start() - 1] != " " or m.start() == 0 and begins
        right = m.end() < len(text) and text[m.end()] != " "
        if left and right:  # its ends are literal too: no part of a longer token
            found.append(f"u:{m.group()}")
    return tuple(found)


def regex_rule(verdict: str, pattern: str) -> Rule:
    """Any regular expression, matched from the beginning of host + path."""
    return Rule(pattern, verdict, pattern, literal_tokens(pattern if pattern.startswith(("^", "\\A")) else "^" + pattern))


def _parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], re.split(r"[?#]", rest[end:], maxsplit=1)[0]
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def _tokens(host: str, path: str) -> set[str]:
    h, p = _TOKEN.findall(host), _TOKEN.findall(path)
    return {f"h:{t}" for t in h} | {f"p:{t}" for t in p} | {f"u:{t}" for t in (*h, *p)}


def token_counts(pages: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many rows hold each token of the rules, counted over all rows; one value a rule token reaches the driver."""
    wanted = frozenset(t for r in rules for t in r.tokens)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        c: Counter = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                c.update(_tokens(*_parts(u)) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

    rows = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


_COMPILED: dict[int, dict] = {}


def _best(candidates, host: str, path: str):
    best = None
    for pattern, r in candidates:
        if pattern.match(host + path) and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
            best = r
    return best


def _result(ids, judged):
    import pyarrow as pa

    cols = list(zip(*judged)) if judged else [()] * 4
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.string()) for c in cols]], ["page_id", "host", "path", "rule", "verdict"])


_SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", most: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    counts = token_counts(pages, rules)
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None), r) for r in rules]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if len(rules) > most:
        return _judge_by_join(rows, filed, default)
    mark = hash(tuple((k, r) for k, r in filed))

    def judge(batches):
        index = _COMPILED.get(mark)
        if index is None:
            _COMPILED.clear()
            index = _COMPILED[mark] = {}
            for k, r in filed:
                index.setdefault(k, []).append((re.compile(r.pattern), r))
        always = index.get(None, [])
        for b in batches:
            judged = []
            for u in b.column(1).to_pylist():
                host, path = _parts(u)
                found = [c for k in _tokens(host, path) for c in index.get(k, ())] if host or path else []
                best = _best([*found, *always] if host else found, host, path)
                judged.append((host, path, best and best.text, best.verdict if best else default))
            yield _result(b.column(0), judged)

    return rows.mapInArrow(judge, _SCHEMA)


def _judge_by_join(rows: DataFrame, filed: list[tuple[str | None, Rule]], default: str) -> DataFrame:
    """The same by a join of the URLs' tokens with the filed rules: each distinct url is judged once, and no task holds all rules."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k or "", r.text, r.verdict, r.pattern) for k, r in filed], "token string, text string, verdict string, pattern string")

    def split(batches):
        import pyarrow as pa

        for b in batches:
            urls, tokens = [], []
            for u in b.column(0).to_pylist():
                host, path = _parts(u)
                mine = [*_tokens(host, path), ""] if host else sorted(_tokens(host, path))
                urls += [u] * len(mine)
                tokens += mine
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(tokens, pa.string())], ["url", "token"])

    def match(batches):
        import pyarrow as pa

        compiled: dict[str, re.Pattern] = {}
        for b in batches:
            keep = []
            for u, p in zip(b.column("url").to_pylist(), b.column("pattern").to_pylist()):
                if p not in compiled:
                    if len(compiled) > 10_000:
                        compiled.clear()
                    compiled[p] = re.compile(p)
                keep.append(compiled[p].match("".join(_parts(u))) is not None)
            yield b.filter(pa.array(keep, pa.bool_()))

    def rest(batches):
        for b in batches:
            urls, texts, verdicts = (b.column(n).to_pylist() for n in ("url", "text", "verdict"))
            yield _result(b.column(0), [(*_parts(u), t, v if v is not None else default) for u, t, v in zip(urls, texts, verdicts)])

    found = rows.where("url is not null").select("url").distinct().mapInArrow(split, "url string, token string").join(table, "token").select("url", "text", "verdict", "pattern")
    best = found.mapInArrow(match, "url string, text string, verdict string, pattern string").groupBy("url").agg(F.max(F.struct(F.length("text"), "text", "verdict")).alias("m"))
    return rows.join(best.select("url", "m.text", "m.verdict"), "url", "left").select("page_id", "url", "text", "verdict").mapInArrow(rest, _SCHEMA)
