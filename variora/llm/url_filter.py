"""URL filters: host and path rules, then pattern rules found through their rarest token.

The literal tokens that any match holds as whole tokens of the URL are read off a rule's
regular expression, for each of its alternatives. A rule is filed, for each alternative, under
that one of its tokens which is rarest among all the URLs; a URL's own tokens fetch the rules
to try, and only those run their regular expressions. A rule with an alternative without such
a token is tried on every URL.
"""

from __future__ import annotations

import re
import re._parser as re_parser
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; this many at most, so that their size has a bound.
MAX_RULES = 200_000
_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    """``rule`` is ``host/path``: it fits the host and its subdomains where the path starts so."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


@dataclass(frozen=True)
class PatternRule:
    """``regex`` is searched in ``host + path`` (A-Z of the host lower-cased)."""

    name: str
    regex: str
    verdict: str = "block"

    def tokens(self) -> list[frozenset[str]] | None:
        """For each alternative, tokens that every match holds whole; None if one has none."""
        found = {_whole_tokens(way) for way in _ways(re_parser.parse(self.regex))}
        return None if frozenset() in found else sorted(found, key=sorted)


#: Ways through a regular expression that are told apart; one with more has no tokens.
MOST_WAYS = 256
#: What a way holds besides literal characters: an edge of tokens, and anything else.
EDGE, OTHER = "edge", "other"


def _step(op, value) -> list[list[str]]:
    """The ways through one element of a parsed expression."""
    if op is re_parser.LITERAL:
        c = chr(value)
        return [[c.lower() if c.isascii() and c.isalnum() else EDGE if c.isascii() else OTHER]]
    if op is re_parser.AT:
        return [[EDGE if value in (re_parser.AT_BEGINNING, re_parser.AT_BEGINNING_STRING, re_parser.AT_END, re_parser.AT_END_STRING) else OTHER]]
    if op is re_parser.IN:
        edges = all(o is re_parser.LITERAL and chr(v).isascii() and not chr(v).isalnum() for o, v in value)
        return [[EDGE if edges else OTHER]]
    if op is re_parser.SUBPATTERN:
        return [[OTHER]] if value[1] or value[2] else _ways(value[3])
    if op is re_parser.BRANCH:
        return [way for branch in value[1] for way in _ways(branch)]
    return [[OTHER]]


def _ways(items) -> list[list[str]]:
    ways: list[list[str]] = [[]]
    for op, value in items:
        steps = _step(op, value)
        if len(ways) * len(steps) > MOST_WAYS:
            return [[OTHER]]
        ways = [way + step for way in ways for step in steps]
    return ways


def _whole_tokens(way: list[str]) -> frozenset[str]:
    """Runs of letters and digits between two edges."""
    text = "".join(x if len(x) == 1 else "." if x == EDGE else "?" for x in way)
    return frozenset(re.findall(r"(?<=\.)[a-z0-9]+(?=\.)", text))


#: The rules of the contract.
HOST_RULES = (
    HostRule("com/", "allow"),
    HostRule("example.com/en/", "block"),
    HostRule("www.example.com/en/", "allow"),
    HostRule("net/es/", "block"),
    HostRule("net/fr/", "block"),
)

#: Spam subjects as host labels or path parts.
PATTERN_RULES = (
    PatternRule("casino", r"(^|[./-])casino([./-]|$)"),
    PatternRule("casino-win", r"casino-win\."),
    PatternRule("free-bets", r"free-bets\."),
    PatternRule("cheap-pills", r"cheap-pills\."),
    PatternRule("adult", r"(^|[./-])(adult|xxx)[./-]"),
    PatternRule("tracker", r"/(ads|track|pixel)/"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; a null URL, or one without ``://``, has both empty."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring_index(u, "://", 1)).otherwise(None)
    after = F.when(rest.isNull(), F.lit("")).otherwise(F.expr(f"substr(coalesce(cast(`{url}` as string), ''), length(substring_index(coalesce(cast(`{url}` as string), ''), '://', 1)) + 4)"))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)})


def _token_counts(parts: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the given tokens; at most as many rows as there are tokens."""
    if not tokens:
        return {}
    asked = parts.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    own = parts.select(F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("t"))
    return {r["t"]: r["count"] for r in own.join(F.broadcast(asked), "t").groupBy("t").count().collect()}


def pattern_index(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """token -> rules to try on URLs that hold it; those under the empty token, on all."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        ways = rule.tokens()
        for token in {""} if ways is None else {min(way, key=lambda t: (counts.get(t, 0), t)) for way in ways}:
            index.setdefault(token, []).append(i)
    return index


def judge_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    default: str = "allow",
    id_column: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict, pattern: one row for each input row, in any order.

    The longest fitting host rule decides (``rule``). Without one (``rule`` null) the first
    matching pattern rule in list order does (``pattern``), and without that ``default``; which
    other URLs there are makes no difference.
    Null and odd URLs have an empty host and path. Other columns are dropped.
    """
    if len(host_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    parts = with_parts(pages.select(pages[id_column].alias(id_column), pages[url].cast("string").alias("_url")), "_url").drop("_url")
    index = pattern_index(pattern_rules, _token_counts(parts, {t for r in pattern_rules for way in r.tokens() or () for t in way}))
    hosts = {}
    for r in sorted(host_rules, key=lambda r: -len(r.rule)):
        hosts.setdefault(r.host, []).append((r.path, r.rule, r.verdict))
    shared = pages.sparkSession.sparkContext.broadcast((hosts, index, [(r.name, r.regex, r.verdict) for r in pattern_rules]))

    def judge(batches):
        hosts, index, patterns = shared.value
        compiled = [re.compile(regex) for _, regex, _ in patterns]
        always = index.get("", [])
        for batch in batches:
            rules, verdicts, names = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                best = None
                at = 0
                while host:
                    for start, rule, verdict in hosts.get(host[at:], ()):
                        if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                            best = (rule, verdict)
                    at = host.find(".", at) + 1
                    if not at:
                        break
                name = None
                if best is None:
                    whole = host + path
                    ids = set(always)
                    for token in set(_TOKEN.findall(whole.lower())):
                        ids.update(index.get(token, ()))
                    hit = next((i for i in sorted(ids) if compiled[i].search(whole)), None)
                    best = (None, default) if hit is None else (None, patterns[hit][2])
                    name = None if hit is None else patterns[hit][0]
                rules.append(best[0])
                verdicts.append(best[1])
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(names, pa.string())],
                [id_column, "host", "path", "rule", "verdict", "pattern"],
            )

    key = parts.schema[id_column].dataType.simpleString()
    return parts.select(id_column, "host", "path").mapInArrow(judge, f"`{id_column}` {key}, host string, path string, rule string, verdict string, pattern string")


def oracle_sql(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> str:
    """DuckDB SQL for ``judge_urls`` over ``pages``."""
    def text(x):
        return "'" + x.replace("'", "''") + "'"

    fits = [
        (r, f"(host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)})")
        for r in sorted(host_rules, key=lambda r: -len(r.rule))
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {text(r.rule)}" for r, c in fits) + " END"
    by_rule = " ".join(f"WHEN {c} THEN {text(r.verdict)}" for r, c in fits)
    hits = [(r, f"regexp_matches(host || path, {text(r.regex)})") for r in pattern_rules]
    pattern = "CASE " + " ".join(f"WHEN {c} THEN {text(r.name)}" for r, c in hits) + " END"
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT *, {rule} AS rule, CASE {by_rule} {" ".join(f"WHEN {c} THEN {text(r.verdict)}" for r, c in hits)} ELSE {text(default)} END AS verdict FROM p)
    SELECT page_id, host, path, rule, verdict, CASE WHEN rule IS NULL THEN {pattern} END AS pattern FROM r
    """
