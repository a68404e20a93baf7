"""URL filter: path rules first, then empirical-Bayes host reputation, in DataFrame operations only.

The pages that a rule decides are the labelled outcomes: 1 for block, 0 for allow.
Hosts, registered domains (the last two labels) and suffixes (the last label) count
theirs. Every level's block rate is beta-binomial around its parent's posterior mean:
all pages -> suffix -> registered domain -> host. A level's prior weight follows from
the analysis-of-variance estimate of how much its members differ (clipped to 1..1000).
A page without a rule is blocked if the one-sided 95 % lower bound of its host's block
rate (normal approximation to the beta posterior) is over one half, else allowed.

Only counts per host cross the network, partially aggregated; the join back is by host,
whose hot keys adaptive execution splits.

Edge cases: a null url or one without :// has an empty host and path and is judged as
host ''; hosts are never null; repeated rows come out once each and count once each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.runtime import written

#: (verdict, host and path prefix)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LIMIT, WEIGHT = 1.645, 0.5, (1.0, 1000.0)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    rest = F.when(F.locate("://", F.col("url")) > 0, F.substr(F.col("url"), F.locate("://", F.col("url")) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Of rules of one length the first wins."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, tail = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def level(counts: DataFrame, key: str, prior: str) -> DataFrame:
    """counts (key, n, k, ..., prior: the parent's mean) with the level's weight and posterior mean and variance."""
    has = F.col("n") > 0
    s = counts.agg(
        F.count_if(has).cast("double").alias("g"), F.sum("n").cast("double").alias("t"), F.sum("k").cast("double").alias("b"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("q"), F.sum(F.when(has, F.col("k") * F.col("k") / F.col("n"))).alias("m"),
    )
    over = F.try_divide  # null where there is nothing to estimate from
    between = over(F.col("m") - over(F.col("b") * F.col("b"), F.col("t")), F.col("g") - 1)
    within = over(F.col("b") - F.col("m"), F.col("t") - F.col("g"))
    each = over(F.col("t") - over(F.col("q"), F.col("t")), F.col("g") - 1)
    share = over(between - within, between + (each - 1) * within)
    usable = (F.col("g") > 1) & (F.col("t") > F.col("g")) & (between + (each - 1) * within > 0) & (between > within)
    kappa = F.when(usable, F.least(F.greatest(over(F.lit(1.0), share) - 1, F.lit(WEIGHT[0])), F.lit(WEIGHT[1]))).otherwise(F.lit(WEIGHT[1]))
    out = counts.crossJoin(F.broadcast(s.select(kappa.alias("kappa"))))  # one row, whatever the input
    mean = (F.col("k") + F.col("kappa") * F.col(prior)) / (F.col("n") + F.col("kappa"))
    out = out.withColumn(f"{key}_mean", mean)
    return out.withColumn(f"{key}_var", F.col(f"{key}_mean") * (1 - F.col(f"{key}_mean")) / (F.col("n") + F.col("kappa") + 1)).drop("kappa")


def reputation(judged: DataFrame) -> DataFrame:
    """host, n and k (its labelled pages and blocks), mean and bound, from rows (host, verdict)."""
    label = F.col("verdict").isNotNull()
    hosts = written(judged.groupBy("host").agg(F.count_if(label).alias("n"), F.count_if(label & (F.col("verdict") == "block")).alias("k")), "hosts")
    hosts = hosts.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    top = hosts.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("top"))
    suffixes = level(hosts.groupBy("suffix").agg(*counts).crossJoin(F.broadcast(top)), "suffix", "top")
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), *counts).join(suffixes.select("suffix", "suffix_mean"), "suffix")
    domains = level(domains, "domain", "suffix_mean")
    out = level(hosts.join(domains.select("domain", "domain_mean"), "domain"), "host", "domain_mean")
    return out.select("host", "n", "k", F.col("host_mean").alias("mean"), (F.col("host_mean") - Z * F.sqrt("host_var")).alias("bound"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    rows = parsed(pages)
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = written(reputation(rows), "reputation")
    method = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(hosts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
        F.col("n").alias("host_labelled"), F.col("k").alias("host_blocked"), F.round("bound", 6).alias("bound"),
    )


def op10(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _level_sql(name: str, frm: str, prior: str) -> str:
    return f"""
{name}_s AS (SELECT CAST(count(*) FILTER (WHERE n > 0) AS DOUBLE) g, CAST(sum(n) AS DOUBLE) t, CAST(sum(k) AS DOUBLE) b,
    CAST(sum(n * n) AS DOUBLE) q, sum(CASE WHEN n > 0 THEN CAST(k * k AS DOUBLE) / n END) m FROM {frm}),
{name}_a AS (SELECT *, CASE WHEN g > 1 THEN (m - b * b / t) / (g - 1) END bt, CASE WHEN t > g THEN (b - m) / (t - g) END wi,
    CASE WHEN g > 1 THEN (t - q / t) / (g - 1) END ea FROM {name}_s),
{name}_k AS (SELECT CASE WHEN g > 1 AND t > g AND bt + (ea - 1) * wi > 0 AND bt > wi
    THEN least(greatest(1 / ((bt - wi) / (bt + (ea - 1) * wi)) - 1, CAST(1 AS DOUBLE)), CAST(1000 AS DOUBLE)) ELSE CAST(1000 AS DOUBLE) END kappa FROM {name}_a),
{name}_p AS (SELECT *, (k + kappa * {prior}) / (n + kappa) mean FROM {frm}, {name}_k)"""


def _rules_sql() -> tuple[str, str]:
    rule, verdict = "NULL", "NULL"
    for what, text in sorted(RULES, key=lambda r: len(r[1])):
        at, slash, tail = text.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash + tail}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return rule, verdict


_RULE, _VERDICT = _rules_sql()
ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS said FROM p),
h0 AS (SELECT host, CAST(count(said) AS BIGINT) n, CAST(count(*) FILTER (WHERE said = 'block') AS BIGINT) k,
    list_extract(string_split(host, '.'), -1) suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM j GROUP BY host),
top AS (SELECT (sum(k) + CAST(0.5 AS DOUBLE)) / (sum(n) + 1) AS top FROM h0),
s0 AS (SELECT suffix, CAST(sum(n) AS BIGINT) n, CAST(sum(k) AS BIGINT) k, any_value(top) AS top FROM h0, top GROUP BY suffix),{_level_sql("s", "s0", "top")},
d0 AS (SELECT domain, CAST(sum(h0.n) AS BIGINT) n, CAST(sum(h0.k) AS BIGINT) k, any_value(s_p.mean) sm FROM h0 JOIN s_p USING (suffix) GROUP BY domain),{_level_sql("d", "d0", "sm")},
e0 AS (SELECT h0.host, h0.n, h0.k, d_p.mean dm FROM h0 JOIN d_p USING (domain)),{_level_sql("e", "e0", "dm")},
b AS (SELECT host, n, k, mean - CAST({Z} AS DOUBLE) * sqrt(mean * (1 - mean) / (n + kappa + 1)) AS bound FROM e_p)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN bound > CAST({LIMIT} AS DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
    n AS host_labelled, k AS host_blocked, round(bound, 6) AS bound FROM j JOIN b ON j.host = b.host
"""
