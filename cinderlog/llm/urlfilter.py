"""URL filter rules behind a token index.

A rule is a pattern in the style of ad-block lists; its literal tokens (runs of a-z0-9 that the pattern
fixes on both sides) must all occur in any URL that it matches. Each rule is filed under the rarest of its
tokens; a URL's own tokens fetch the rules filed under them, and only those run their regular expressions.
The index is a literal of the plan, read from one JSON string when the plan is made and split by a hash of the token, so that a fetch costs the
same however many rules there are, and the pages are neither exploded nor shuffled. A list may have MOST_RULES rules.

Pattern syntax: ``||host/path`` matches that host or a subdomain of it, with a path that starts so (none: any);
``|text`` is anchored at the host's start; ``*`` is any run; ``^`` is a separator (any character but a-z, 0-9,
A-Z, ``_``, ``%``) or the end. Letters match in either case, but for base rules, whose path is compared as it is. Rules without a token are
tried on every URL.

Defined results: null URLs and URLs without ``://`` have empty host and path, match nothing and are allowed;
base rules go before others; of several that match the longest pattern wins, of equally long ones the last in the order of their patterns,
of equal patterns ``block``; repeated rows are judged each; URLs of any length are read whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "(?:[^a-zA-Z0-9_%]|$)"
MOST_RULES = 200_000  # of a list: what the plan's literal is made for


@dataclass(frozen=True)
class UrlRule:
    pattern: str
    verdict: str  # allow or block
    base: bool = False  # a host and path rule: these go first, the longest wins


#: Fixed rules of the site policy.
BASE_RULES = (
    UrlRule("||com/", "allow", True),
    UrlRule("||example.com/en/", "block", True),
    UrlRule("||www.example.com/en/", "allow", True),
    UrlRule("||net/es/", "block", True),
    UrlRule("||net/fr/", "block", True),
)
#: Patterns for what the policy leaves open: gambling, pharmacy spam, adult and piracy sites, trackers.
PATTERN_RULES = tuple(
    UrlRule(p, "block")
    for p in (
        "^casino^", "^bets^", "^poker^", "^jackpot^", "^pills^", "^viagra^", "^pharmacy-online^", "^porn^", "^xxx^",
        "^warez^", "^torrent^", "^free-download^", "^adserver^", "^doubleclick^", "^wp-login.php", "^cgi-bin^",
        "^ads^", "^track^", "^tracker^", "^banner^", "^popunder^", "||*.loan^", "/affiliate/*/click^",
    )
)


def compiled(rule: UrlRule) -> tuple[str, list[str]]:
    """The rule's regular expression over host + path, and its tokens."""
    body, head = rule.pattern, ""
    if body.startswith("||"):
        body, head = body[2:], r"^(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    anchored = bool(head)
    parts = [".*" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body]
    if not anchored and body.startswith("^"):
        parts[0] = "(?:[^a-zA-Z0-9_%]|^)"
    tokens = [
        m[0].lower()
        for m in re.finditer(r"[A-Za-z0-9]+", body)
        if (m.start() > 0 or anchored) and body[m.start() - 1 : m.start()] != "*" and m.end() < len(body) and body[m.end()] != "*"
    ]
    return ("(?s)" if rule.base else "(?is)") + head + "".join(parts), tokens


def rules_of(table: DataFrame) -> list[UrlRule]:
    """The rules of a table (pattern, verdict and, if there, base), MOST_RULES at most."""
    base = F.col("base") if "base" in table.columns else F.lit(False)
    rows = table.select("pattern", "verdict", base.alias("base")).distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted((UrlRule(r.pattern, r.verdict, bool(r.base)) for r in rows if r.pattern and r.verdict), key=lambda r: (r.pattern, r.verdict, r.base))


def rule_length(rule: UrlRule) -> int:
    return len(rule.pattern.lstrip("|"))


ENTRIES = "array<struct<base:int,length:int,rule:string,verdict:string,regex:string>>"
SPREAD = 1 << 24


def spread(token: str) -> int:
    """A hash of a token that SQL functions can compute, too."""
    h = 0
    for c in token.encode():
        h = h * 31 % SPREAD + c
    return h


def build_index(rules, slots: int | None = None) -> tuple[list[dict[str, list[int]]], list[int]]:
    """Slots of token -> rule numbers, and the rules without a token. Rare: used by the fewest rules, then longest."""
    tokens = [compiled(r)[1] for r in rules]
    uses = Counter(t for ts in tokens for t in set(ts))
    filed: dict[str, list[int]] = {}
    rest = []
    for i, ts in enumerate(tokens):
        if ts:
            filed.setdefault(min(ts, key=lambda t: (uses[t], -len(t), t)), []).append(i)
        else:
            rest.append(i)
    n = slots or max(1, 1 << (len(filed) // 4).bit_length())
    out: list[dict[str, list[int]]] = [{} for _ in range(n)]
    for t, ids in sorted(filed.items()):
        out[spread(t) % n][t] = ids
    return out, rest


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    has = F.instr(url, "://") > 0
    rest = F.expr("substring_index(url, '://', 1)")
    after = F.substr(url, F.char_length(rest) + 4)
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    fill = lambda c: F.when(has, c).otherwise("")
    return fill(F.translate(host, UPPER, LOWER)), fill(path)


def judge(pages: DataFrame, rules=BASE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict, method_rule and n_candidates."""
    rules = list(rules)
    slots, rest = build_index(rules)
    n = len(slots)
    entry = lambda r: {"base": int(r.base), "length": rule_length(r), "rule": r.pattern.lstrip("|"), "verdict": r.verdict, "regex": compiled(r)[0]}
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)  # noqa: E731  # folded when the plan is optimized
    table = literal([entry(r) for r in rules], ENTRIES)
    index = literal(slots, "array<map<string,array<int>>>")

    host, path = split_url(F.col("url"))
    out = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    out = out.withColumn("_target", F.concat("host", "path"))
    words = F.array_distinct(F.filter(F.split(F.translate("_target", UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))
    out = out.withColumn("_tokens", words)
    letters = lambda t: F.split(t, "")
    slot_of = lambda t: F.aggregate(letters(t), F.lit(0), lambda s, c: s * 31 % SPREAD + F.coalesce(F.ascii(c), F.lit(0))) % F.lit(n) + 1
    found = F.flatten(F.filter(F.transform("_tokens", lambda t: F.element_at(F.element_at(index, slot_of(t)), t)), lambda x: x.isNotNull()))
    numbers = F.concat(found, literal(rest, "array<int>"))
    out = out.withColumn("_candidates", F.transform(numbers, lambda i: F.element_at(table, i + 1)))
    out = out.withColumn("_hits", F.filter("_candidates", lambda r: F.rlike(F.col("_target"), r["regex"])))
    best = F.array_max(F.filter("_hits", lambda r: r["base"] == 1))
    other = F.array_max(F.filter("_hits", lambda r: r["base"] == 0))
    out = out.withColumns({"_best": best, "_other": other})
    return out.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", "_other.verdict", F.lit(default)).alias("verdict"),
        F.col("_other.rule").alias("method_rule"), F.size("_candidates").alias("n_candidates"),
    )


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("n_candidates")


def _patterns_sql() -> str:
    cases = []
    for r in sorted(PATTERN_RULES, key=lambda r: (-rule_length(r), [-ord(c) for c in r.pattern])):
        cases.append("WHEN regexp_matches(host || path, '" + compiled(r)[0].replace("'", "''") + f"') THEN '{r.pattern}'")
    return "CASE " + " ".join(cases) + " END"


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  {_patterns_sql()} AS method_rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_rule FROM judged
"""
