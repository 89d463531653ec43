"""URL filtering by host/path rules and by pattern rules indexed by their rarest literal token (op 2).

A host/path rule fits its host and all subdomains if the path starts with the rule's; the longest
fitting rule decides. Other URLs go to the pattern rules, regular expressions. The whole tokens that an
expression asks for are read from its parsed form, for each of its alternatives (``pattern_tokens``). A rule is
indexed under one token of each alternative: the one that is rarest among all URLs of the table (a count over
the whole table, of the rules' tokens only). A URL's tokens fetch its candidate rules from that index, and only
those run their expression; rules with an alternative that asks for no token are always candidates. Of the
fitting patterns an allow rule beats a block rule; a URL that no rule fits is allowed.

Rules are a parameter of the operator, not data: tens of thousands travel with each task, and a worker compiles those
that it runs.

Defined results: a null URL or one without ``://`` has empty host and path, and only pattern rules can
fit it (a null URL is the empty text); repeated rows give a row each; an empty table gives an empty
result; other columns are ignored. Tokens are runs of ASCII letters and digits, lower-cased, where the four
characters that match ASCII letters when case is ignored count as these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches
from exposa.llm.pattern_tokens import LOWER, needed, tokens


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str


#: The fixed host/path rules of the production list.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Pattern rules of the production list: sites and paths that no training corpus wants.
PATTERN_RULES = (
    PatternRule("block", r"(?i)://([a-z0-9-]+\.)*spam-farm\."),
    PatternRule("block", r"(?i)://([a-z0-9-]+\.)*adult-x\."),
    PatternRule("block", r"(?i)://([a-z0-9-]+\.)*casino(-[a-z0-9]+)*\."),
    PatternRule("block", r"(?i)[/?&.](porn|xxx)[/?&.=]"),
    PatternRule("block", r"(?i)[?&](sessionid|phpsessid|jsessionid)="),
    PatternRule("block", r"(?i)/wp-(login|admin)(\.php|/|$)"),
    PatternRule("block", r"(?i)/(cart|checkout)/(add|pay)(/|$)"),
    PatternRule("allow", r"(?i)://([a-z0-9-]+\.)*example\.com/[a-z]+/[0-9]+/?(\.html)?$"),
)
SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                    ("rule", pa.string()), ("verdict", pa.string()), ("n_candidates", pa.int64())])


_LOWER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


_FOLDS = "".join(map(chr, LOWER)), "".join(map(chr, LOWER)).translate(LOWER)


def token_counts(pages: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """In how many URLs of the table each of the rules' tokens stands (as many rows as tokens)."""
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.col("url"), *_FOLDS), F.lit("([a-z0-9]+)"), 1))
    rows = (pages.select(F.explode(F.array_intersect(found, F.split(F.lit(" ".join(wanted)), " "))).alias("token"))
            .groupBy("token").count().collect()) if wanted else []
    return {r["token"]: r["count"] for r in rows}


#: A worker's expressions: as many as there are rules at most.
_compiled = cache(re.compile)


class RuleIndex:
    def __init__(self, host_rules: Sequence[HostRule], pattern_rules: Sequence[PatternRule], counts: dict[str, int]):
        self.hosts: dict[str, list[HostRule]] = {}
        for r in sorted(host_rules, key=lambda r: -len(r.host + r.path)):
            self.hosts.setdefault(r.host, []).append(r)
        self.patterns = [(r.verdict, r.pattern) for r in pattern_rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(pattern_rules):
            alternatives = needed(r.pattern)
            if all(alternatives):
                for t in {min(a, key=lambda t: (counts.get(t, 0), t)) for a in alternatives}:
                    self.by_token.setdefault(t, []).append(i)
            else:
                self.always.append(i)

    def host_rule(self, host: str, path: str) -> HostRule | None:
        best = None
        while host:
            for r in self.hosts.get(host, ()):
                if path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
                    best = r
            host = host.partition(".")[2]
        return best

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        """host, path, rule, verdict and how many pattern rules ran."""
        url = url or ""
        host, path = host_and_path(url)
        rule = self.host_rule(host, path)
        if rule:
            return host, path, rule.host + rule.path, rule.verdict, 0
        candidates = {*self.always, *(i for t in tokens(url) for i in self.by_token.get(t, ()))}
        verdicts = {verdict for verdict, p in map(self.patterns.__getitem__, candidates) if _compiled(p).search(url)}
        verdict = "block" if verdicts == {"block"} else "allow"
        return host, path, None, verdict, len(candidates)


def filter_urls(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES,
                pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, n_candidates (pattern rules that ran)."""
    index = RuleIndex(host_rules, pattern_rules,
                      token_counts(pages, sorted({t for r in pattern_rules for a in needed(r.pattern) for t in a})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            host, path, rule, verdict, n = zip(*map(index.judge, rows.column("url").to_pylist())) if len(rows) else [[]] * 5
            yield batch(SCHEMA, {"page_id": rows.column("page_id"), "host": host, "path": path, "rule": rule,
                                 "verdict": verdict, "n_candidates": n})

    inputs = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return in_batches(inputs, run, "page_id long, host string, path string, rule string, verdict string, "
                      "n_candidates long")


def oracle(host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> str:
    """DuckDB SQL that tries every rule on every URL. It states the index's gain too: a pattern
    rule's candidates are not compared."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    fits = "CASE " + " ".join(
        f"WHEN (host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)}) "
        f"THEN {text(r.host + r.path)}"
        for r in sorted(host_rules, key=lambda r: -len(r.host + r.path))) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = {text(r.host + r.path)} THEN {text(r.verdict)}" for r in host_rules)
    by = {v: " OR ".join(f"regexp_matches(u, {text(r.pattern)})" for r in pattern_rules if r.verdict == v) or "false"
          for v in ("allow", "block")}
    lower = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') u FROM pages),
a AS (SELECT page_id, u, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END rest FROM p),
b AS (SELECT page_id, u, {lower} host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path FROM a),
c AS (SELECT *, {fits} rule FROM b)
SELECT page_id, host, path, rule, {verdict} WHEN {by['allow']} THEN 'allow' WHEN {by['block']} THEN 'block' ELSE 'allow' END verdict
FROM c"""
