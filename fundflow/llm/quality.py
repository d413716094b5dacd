"""Quality rules with host-level verdicts.

Per document, the base counts and whether it fails a base rule (too few
words; too many words in repeated three-word windows).  Per host (the
documents' ``source``) the failures are aggregated and the failure rate is
shrunk towards the corpus by a beta prior fitted to all hosts by moments:
``(alpha + failures) / (alpha + beta + documents)``.  A host whose shrunken
rate is above ``HOST_RATE`` is rejected, and its verdict is joined back to
its documents.  A host of few documents stays near the corpus rate, so it
takes evidence to reject one.

DataFrame functions only.  The per-document counts are made within the row
(no exchange of words); they are written once and the host totals combine
before their exchange, so a hot host is no hot task; the join back moves
only the counts, and hosts are broadcast or salted.

Defined results: null text has no words (fails); a null source is a host of
its own; repeated rows count and are returned each; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BLANKS = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: A host with a shrunken failure rate above this is rejected.
HOST_RATE = 0.5
#: Hosts that may be broadcast (counted first), and salts of a larger join.
MOST_HOSTS, SALTS = 100_000, 32
#: Bounds of alpha + beta, the prior's weight in documents.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0


def document_counts(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``doc_id, source``, the base counts and a struct ``rest`` of the columns ``keep`` of every row of
    ``docs(doc_id, source, text)``."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []
    also = ["rest"] if keep else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       text.alias("text"), *rest)
    rows = rows.select(
        "doc_id", "source", *also,
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda s: F.translate(s, " \t\n\x0b\x0c\r", "") != "").alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    rows = rows.select(
        "doc_id", "source", *also, "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(words) >= 4 THEN transform(sequence(0, size(words) - 3),
                  i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END""").alias("windows"))
    # only texts with a repeated window are sorted
    rows = rows.withColumn("sorted", F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
        THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"""))
    rows = rows.withColumn("places", F.expr("""sort_array(transform(filter(sorted, (x, k) ->
        coalesce(x.h = get(sorted, k - 1).h, false) OR coalesce(x.h = get(sorted, k + 1).h, false)), x -> x.i))"""))
    repeat = F.expr("""coalesce(aggregate(transform(places, (p, k) -> least(3, coalesce(get(places, k + 1) - p, 3))),
        0L, (a, x) -> a + x), 0L)""")
    return rows.select("doc_id", "source", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_of() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def host_rates(hosts: DataFrame) -> DataFrame:
    """``host, host_docs, host_failures`` with ``host_rate`` under the fitted prior."""
    n, k = F.col("host_docs"), F.col("host_failures")
    # one row: the moments of all hosts
    m = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"),
                  F.sum(k * k / n).alias("squares")).first()
    alpha, beta = beta_prior(m.hosts, m.n or 0, m.k or 0, m.squares or 0.0)
    return hosts.withColumn("host_rate", (k + F.lit(alpha)) / (n + F.lit(alpha + beta)))


def beta_prior(hosts: int, n: int, k: int, squares: float) -> tuple[float, float]:
    """alpha and beta by moments: between-host variance is what the binomial one doesn't explain."""
    if not n:
        return PRIOR_LEAST / 2, PRIOR_LEAST / 2
    mean = (k + 0.5) / (n + 1)
    between = (squares - k * k / n - (hosts - 1) * mean * (1 - mean)) / n
    weight = mean * (1 - mean) / between - 1 if between > 0 else PRIOR_MOST
    weight = min(max(weight, PRIOR_LEAST), PRIOR_MOST)
    return mean * weight, (1 - mean) * weight


def with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` joined with a table of hosts, so that a hot host is no hot task.

    Up to MOST_HOSTS hosts are broadcast.  Beyond, the hosts are repeated for
    each of SALTS salts and a host's rows are dealt over them.
    """
    if hosts.count() <= MOST_HOSTS:
        return rows.join(F.broadcast(hosts), "host")
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    repeated = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, ["host", "_salt"]).drop("_salt")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, the host's rate and ``kept`` for every row of ``docs``."""
    counts = written(document_counts(docs).select(
        "*", base_failed().alias("base_failed"), host_of().alias("host")), "quality")
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"),
                                       F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    rates = written(host_rates(hosts).select("host", "host_docs", "host_rate"), "hosts")
    return with_hosts(counts, rates).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= HOST_RATE)).alias("kept"), "host_docs")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Of rows that fail a base rule only the verdict is written.  (The verdict is
    a column before it is a filter: pushed below the counts it would repeat
    their expressions many times over.)
    """
    verdicts = document_counts(docs, docs.columns).select(host_of().alias("host"), base_failed().alias("failed"), "rest")
    rows = written(verdicts.select("host", "failed", F.when(~F.col("failed"), F.col("rest")).alias("rest")), "verdicts")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failures"))
    accepted = written(host_rates(hosts).where(F.col("host_rate") <= HOST_RATE).select("host"), "accepted-hosts")
    return with_hosts(rows.where(~F.col("failed")), accepted).select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def quality_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op1: every document."""
    return quality_rules(docs)


def quality_sql(table: str = "documents", columns: str | None = None) -> str:
    """op1 in DuckDB SQL; ``columns`` replaces the final select list."""
    columns = columns or ("c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
                          f"NOT base_failed AND (alpha + k) / (alpha + beta + n) <= {HOST_RATE} AS kept, n AS host_docs")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, * FROM {table}),
w AS (
  SELECT r, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words FROM d),
t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 4)),
q AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t WHERE c > 1) GROUP BY r),
l AS (
  SELECT r, coalesce(sum(c - 1), 0)::BIGINT AS n_dup_lines
  FROM (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) GROUP BY r),
c AS (
  SELECT d.*, len(words)::BIGINT AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(words) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(words) AS base_failed
  FROM d JOIN w USING (r) LEFT JOIN q USING (r) LEFT JOIN l USING (r)),
h AS (
  SELECT source AS host, count(*) AS n, sum(base_failed::BIGINT)::BIGINT AS k FROM c GROUP BY source),
m AS (
  SELECT count(*) AS hosts, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(k * k / n::DOUBLE) AS squares FROM h),
v AS (
  SELECT (k + 0.5::DOUBLE) / (n + 1) AS mean,
         (squares - k * k / n - (hosts - 1) * ((k + 0.5::DOUBLE) / (n + 1)) * (1 - (k + 0.5::DOUBLE) / (n + 1))) / n AS between_hosts
  FROM m),
z AS (
  SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE {PRIOR_MOST}::DOUBLE END,
                              {PRIOR_LEAST}::DOUBLE), {PRIOR_MOST}::DOUBLE) AS weight FROM v),
a AS (
  SELECT mean * weight AS alpha, (1 - mean) * weight AS beta FROM z)
SELECT {columns}
FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.host CROSS JOIN a
"""
