"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

A host rule fits its host and all its subdomains if the path starts with the rule's; the longest one wins. Where none
fits, pattern rules decide: each has alternative sets of literal tokens, one of which must occur whole among the URL's
tokens wherever its regular expression matches (an optional separator gives two: apart and joined).
Rules are indexed by the token of each set that is rarest in the URLs themselves (one aggregation, restricted to the
rules' own tokens, so its result is bounded by the rules); a URL's tokens fetch candidate rules, and only those run
their expressions. Any match blocks, no match allows.

Plan: up to MAP_RULES rules the index is a literal map and nothing is shuffled; more rules take an equi-join on tokens.
Only built-in functions are used.

Cases: a null url or one without `://` has an empty host and path and is judged by its patterns alone (null: allow);
repeated rows are judged each for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Verdict, host, path.
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Pattern rules: alternative sets of literal tokens and a regular expression over the lower-cased URL. Every match holds
#: all tokens of one set as whole tokens; what an expression may match as part of a token is in no set.
PATTERN_RULES = [
    ([["spam", "farm"], ["spamfarm"]], r"\bspam[-_.]?farm\b"),
    ([["cheap", "pills"], ["cheappills"]], r"\bcheap[-_.]?pills\b"),
    ([["online", "casino"], ["onlinecasino"]], r"\bonline[-_.]?casino\b"),
    ([["free", "porn"], ["freeporn"]], r"\bfree[-_.]?porn\b"),
    ([["xxx", "videos"], ["xxxvideos"]], r"\bxxx[-_./]?videos\b"),
    ([["payday", "loans"], ["paydayloans"]], r"\bpayday[-_.]?loans\b"),
    ([["crack", "keygen"]], r"\bcrack\b.*\bkeygen\b"),
    ([["wp", "login"]], r"/wp-login\.php"),
    ([["phpsessid"]], r"[?&]phpsessid="),
    ([["doubleclick", "net"]], r"\bdoubleclick\.net\b"),
]
MAP_RULES = 2000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Literal host (A-Z lower-cased) and path; empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.trim(F.regexp_replace(lower_ascii(F.coalesce(url, F.lit(""))), r"[^0-9a-z]+", " ")), " "))


def rarest_tokens(pages: DataFrame, rules=PATTERN_RULES) -> list[list[str]]:
    """For each set of each rule its literal token that the fewest URLs hold (ties: the longer, then the first by name)."""
    known = sorted({t for sets, _ in rules for tokens in sets for t in tokens})
    wanted = F.array(*map(F.lit, known))
    rows = pages.select(F.explode(F.array_intersect(url_tokens(F.col("url")), wanted)).alias("token")).groupBy("token").count().collect()
    count = {r["token"]: r["count"] for r in rows}
    return [sorted({min(tokens, key=lambda t: (count.get(t, 0), -len(t), t)) for tokens in sets}) for sets, _ in rules]


def pattern_hits(pages: DataFrame, rules=PATTERN_RULES, map_rules: int = MAP_RULES) -> DataFrame:
    """pages with _rules: the numbers of the pattern rules that match, ascending."""
    keys = rarest_tokens(pages, rules)
    low = lower_ascii(F.coalesce(F.col("url"), F.lit("")))
    if len(rules) <= map_rules:
        index: dict[str, list[int]] = {}
        for k, tokens in enumerate(keys):
            for token in tokens:
                index.setdefault(token, []).append(k)
        known = F.array(*map(F.lit, sorted(index)))
        postings = F.create_map(*(c for t in sorted(index) for c in (F.lit(t), F.array(*map(F.lit, index[t])))))
        candidates = F.flatten(F.transform(F.array_intersect(url_tokens(F.col("url")), known), lambda t: F.element_at(postings, t)))
        with_ids = pages.withColumn("_candidates", candidates)
        runs = [F.when(F.array_contains("_candidates", k) & low.rlike(p), F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) for k, (_, p) in enumerate(rules)]
        return with_ids.withColumn("_rules", F.when(F.size("_candidates") > 0, F.concat(*runs)).otherwise(F.array().cast("array<int>"))).drop("_candidates")
    table = pages.sparkSession.createDataFrame([(token, k, p) for k, (_, p) in enumerate(rules) for token in keys[k]], "_token string, _rule int, _pattern string")
    rows = pages.withColumn("_row", F.monotonically_increasing_id())
    tokens = rows.select("_row", low.alias("_low"), F.explode(url_tokens(F.col("url"))).alias("_token"))
    found = tokens.join(table, "_token").filter("_low rlike _pattern").groupBy("_row").agg(F.sort_array(F.collect_set("_rule")).alias("_rules"))
    out = rows.join(found, "_row", "left").drop("_row")
    return out.withColumn("_rules", F.coalesce("_rules", F.array().cast("array<int>")))


def judge(pages: DataFrame, host_rules=HOST_RULES, rules=PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rules)."""
    found = pattern_hits(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    host, path = host_and_path(F.col("url"))
    found = found.select("page_id", host.alias("host"), path.alias("path"), "_rules")
    name, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    own = F.when(F.size("_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def oracle() -> str:
    """The same verdicts in DuckDB's SQL, every pattern tried on every URL."""
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))]
    kinds = {h + p: k for k, h, p in HOST_RULES}
    names = [h + p for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))]
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = lower.format("coalesce(url, '')")
    own = " OR ".join(f"regexp_matches(low, '{p}')" for _, p in PATTERN_RULES)
    return f"""
WITH a AS (SELECT page_id, {low} AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path,
  CASE {' '.join(f"{f} '{n}'" for f, n in zip(fits, names, strict=True))} END AS rule,
  CASE {' '.join(f"{f} '{kinds[n]}'" for f, n in zip(fits, names, strict=True))} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict
FROM b"""
