"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens (runs of a-z and 0-9) that any URL fitting
it must hold as whole tokens; a rule without one has the empty token, which
every URL holds.  The rule index maps each rule's rarest such
token, by its count over all pages, to the rule.  The tokens of each URL
fetch candidate rules by one join, and only the candidates' regular
expressions run.  The longest fitting rule wins.

Host and path rules (``host/path`` fits the host and its subdomains where
the URL's path starts with the rule's) decide first; where none fits, the
pattern rules block, and everything else is allowed.

DataFrame functions only.  Rows are regrouped by URL, never by host, so a
hot host stays spread; a URL repeated by many pages is combined before the
exchange.  Rules that share a token with a third of all pages meet them in
a join that splits skewed partitions; up to ``MOST_RULES`` rules, counted
before, are broadcast instead.

Defined results: a null URL, or one without ``://``, has empty host and
path, no rule and verdict allow; repeated rows give one row each; an empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The host and path rules.
HOST_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: The method's own patterns over ``host + path`` (A-Z lower-cased) and the tokens that every fitting URL
#: holds whole; a text with an optional or open end (``ads?``, ``php``) is no such token.
PATTERN_RULES = [
    (r"(?:\A|\.)ads?-[a-z]+\.", []),
    (r"(?:\A|\.)ads?[0-9]*\.", []),
    (r"(?:\A|\.)(?:[a-z0-9]+-)*tracker\.", ["tracker"]),
    (r"(?:\A|\.)doubleclick\.", ["doubleclick"]),
    (r"/wp-login\.php", ["wp", "login"]),
    (r"/cgi-bin/", ["cgi", "bin"]),
    (r"[./-]casino[./-]", ["casino"]),
    (r"[./-]porn[./-]", ["porn"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that may be broadcast; a larger table is joined by its tokens.
MOST_RULES = 50_000
RULES = "rule string, pattern string, tokens array<string>, verdict string, base boolean"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def literal(text: str) -> str:
    """``text`` as a regular expression that fits it alone."""
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def host_rule(rule: str, verdict: str) -> tuple:
    """A row of the rule table for a host and path rule.

    A host's tokens are whole (a subdomain ends in a dot); the last token of
    the path is whole only if a sign follows it in the rule.
    """
    tokens = re.findall(r"[a-z0-9]+(?![a-z0-9])", rule.lower())
    if "/" in rule and re.search(r"[a-z0-9]\Z", rule.lower()):
        tokens = tokens[:-1]
    return rule, r"(?s)\A(?:[^/]*\.)?" + literal(rule), sorted(set(tokens)), verdict, True


def rule_table(spark: SparkSession, hosts=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    rows = [host_rule(*h) for h in hosts]
    rows += [(p, p, sorted(set(t)), "block", False) for p, t in patterns]
    return spark.createDataFrame(rows, RULES)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), UPPER, LOWER), F.regexp_extract(text, _PARTS, 2)


def url_tokens(address: Column) -> Column:
    """Distinct whole tokens, and the empty token, which fetches rules without a literal."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")))


def rule_index(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules keyed by their rarest token: ``token, rule, pattern, verdict, base``."""
    own = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    wanted = own.select("token").distinct()
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(counts, "token", "left").groupBy("rule", "pattern", "verdict", "base").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return ranked.select(F.col("rarest.token").alias("token"), "rule", "pattern", "verdict", "base")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for every row of ``pages(page_id, url)``."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    address = F.concat("host", "path")
    tokens = rows.select("url", address.alias("address"), F.explode(url_tokens(address)).alias("token"))
    index = rule_index(tokens, rules)
    if rules.count() <= MOST_RULES:  # the index has a row per rule
        index = F.broadcast(index)
    hits = (tokens.join(index, "token")
            .where(F.regexp_like(F.when(F.col("base"), F.col("address")).otherwise(
                F.translate("address", UPPER, LOWER)), F.col("pattern"))))
    place = F.struct(F.length("rule").alias("size"), "rule", "verdict")
    best = hits.groupBy("url").agg(
        F.max(F.when(F.col("base"), place)).alias("host_rule"),
        F.max(F.when(~F.col("base"), place)).alias("pattern_rule"))
    return rows.join(best, "url", "left").select(
        "page_id", "host", "path", F.col("host_rule.rule").alias("rule"),
        F.coalesce("host_rule.verdict", "pattern_rule.verdict", F.lit("allow")).alias("verdict"),
        F.col("pattern_rule.rule").alias("pattern"))


def url_query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """op5: every page."""
    return judge_urls(pages, rule_table(spark))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_sql() -> str:
    """op5 in DuckDB SQL: every rule against every URL."""
    rules = ", ".join(f"({_sql_text(r)}, {_sql_text(r.split('/')[0])}, {_sql_text('/' + r.split('/', 1)[1])}, {_sql_text(v)})"
                      for r, v in HOST_RULES)
    patterns = ", ".join(f"({_sql_text(p)})" for p, _ in PATTERN_RULES)
    return f"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(rule, h, p, verdict) AS (VALUES {rules}),
o(pattern) AS (VALUES {patterns})
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best.rule IS NOT NULL THEN best.verdict WHEN own.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       own.pattern AS pattern
FROM p
LEFT JOIN LATERAL (
  SELECT rule, verdict FROM r
  WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  ORDER BY length(rule) DESC, rule DESC LIMIT 1) best ON true
LEFT JOIN LATERAL (
  SELECT pattern FROM o WHERE regexp_matches(translate(p.host || p.path, '{UPPER}', '{LOWER}'), o.pattern)
  ORDER BY length(pattern) DESC, pattern DESC LIMIT 1) own ON true
"""
