"""URL filters: empirical-Bayes host reputation with explicit rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, write_table

#: (action, host, path prefix); the longest that fits wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of more than one label; a deployment passes the public list.  All other hosts end in one label.
SUFFIXES = tuple(f"{kind}.{land}" for land in ("au", "br", "in", "jp", "kr", "nz", "uk", "za") for kind in ("ac", "co", "com", "edu", "gov", "net", "org"))
#: A host is blocked if the lower bound of its share of bad pages, the posterior's quantile at -Z on the logit scale, is above LIMIT.
Z, LIMIT = 1.645, 0.35
#: Terms of the recurrence before the asymptotic series of digamma and trigamma.
STEPS = 6
#: Strength of a level's prior where its groups tell nothing.
DEFAULT_STRENGTH = 20.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without `://`.  A-Z of the host are lower-cased."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host, a subdomain included, and starts the path; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _strength(groups: DataFrame) -> float:
    """Beta-binomial prior strength a + b of groups (n, k), by moments."""
    seen = groups.filter("n > 0")
    g, n, k, n2 = seen.agg(F.count(F.lit(1)), F.sum("n"), F.sum("k"), F.sum(F.col("n") * F.col("n"))).first()
    if not g or g < 2 or not 0 < k < n:
        return DEFAULT_STRENGTH
    m = k / n
    (spread,) = seen.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2.0))).first()
    rho = (spread - (g - 1) * m * (1 - m)) / (m * (1 - m) * (n - n2 / n - (g - 1)))
    rho = min(max(rho, 0.001), 0.5)
    return (1 - rho) / rho


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, whose user and port don't count.

    An address (v4, or v6 in brackets) is a domain of its own under an empty
    suffix; a host that is a suffix itself is its own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    parts = F.split(bare, r"\.")

    def last(n: int) -> Column:
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")

    address = bare.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$") | bare.startswith("[")
    n = F.lit(1)
    for k in sorted({x.count(".") + 1 for x in suffixes}):  # the longest is asked first
        n = F.when(last(k).isin(*[x for x in suffixes if x.count(".") == k - 1]), k).otherwise(n)
    suffix, domain = F.lit(None), F.lit(None)
    for k in sorted({1, *[x.count(".") + 1 for x in suffixes]}):
        suffix, domain = F.when(n == k, last(k)).otherwise(suffix), F.when(n == k, last(k + 1)).otherwise(domain)
    return F.when(address, bare).otherwise(domain), F.when(address, "").otherwise(suffix)


def _digamma(x: Column) -> Column:
    y = x + STEPS
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y)
    return series - sum((1 / (x + i) for i in range(1, STEPS)), 1 / x)


def _trigamma(x: Column) -> Column:
    y = x + STEPS
    series = 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * y * y * y * y * y)
    return series + sum((1 / ((x + i) * (x + i)) for i in range(1, STEPS)), 1 / (x * x))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, mean, bound) of every host from labelled pages (host, bad).

    Counts of a host are shrunk towards its registered domain's posterior mean,
    the domain's towards its suffix's, the suffix's towards the overall share;
    each level's prior strength comes from the spread of its groups.  A host
    without labelled pages has its domain's mean with the prior's variance.
    The host's posterior is Beta(a, b); `bound` is its lower quantile, taken on
    the logit scale, where the mean is digamma(a) - digamma(b) and the variance
    trigamma(a) + trigamma(b): it follows the skew of small counts and lies
    between 0 and 1.  There b counts as 1 at least, as if one good page were
    still expected: without it a host of bad pages alone would have no bound.
    Against exact quantiles the bound is at most 0.03 too high, and 0.1 too low
    where b is 1 or more.
    """
    counted = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    named = counted.unionByName(hosts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k")))
    named = named.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domain, suffix = levels(F.col("host"), suffixes)
    by_host = write_table(named.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "url-hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_domain = write_table(by_domain, "url-domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = by_suffix.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + 1) / ((n or 0) + 2)
    s1, s2, s3 = _strength(by_suffix), _strength(by_domain), _strength(by_host)
    by_suffix = by_suffix.select("suffix", ((F.col("k") + s1 * overall) / (F.col("n") + s1)).alias("m1"))
    by_domain = by_domain.join(by_suffix, "suffix").select(
        "domain", "suffix", ((F.col("k") + s2 * F.col("m1")) / (F.col("n") + s2)).alias("m2")
    )
    found = by_host.join(write_table(by_domain, "url-domains"), ["domain", "suffix"])
    found = found.select("host", (F.col("k") + s3 * F.col("m2")).alias("a"), (F.col("n") + s3).alias("size"))
    found = found.select("host", "a", (F.col("size") - F.col("a")).alias("b"), (F.col("a") / F.col("size")).alias("mean"))
    good = F.greatest("b", F.lit(1.0))
    low = _digamma(F.col("a")) - _digamma(good) - Z * F.sqrt(_trigamma(F.col("a")) + _trigamma(good))
    return found.select("host", "mean", (1 / (1 + F.exp(-low))).alias("bound"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound) of every page.

    A page's outcome is the label of the document whose number follows the first
    part of its path: bad if of low quality or toxic.  A null URL or one without
    `://` has an empty host, which is judged like any other; null and repeated
    labels are reduced to one per document; equal pages are all kept; further
    columns are ignored.
    """
    host, path = url_parts(F.col("url").cast("string"))
    slim = pages.select("page_id", host.alias("host"), path.alias("path"))
    slim = write_table(slim, "url-pages")
    doc = F.expr(r"try_cast(regexp_extract(path, '^/[^/]*/([0-9]{1,15})', 1) as bigint)")
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(bad.cast("long").alias("bad"))
    known = write_table(known, "url-labels")  # tables on both sides let a hot key be split
    outcomes = slim.select("host", doc.alias("doc")).filter("doc is not null").join(known, "doc")
    reputation = write_table(host_reputation(outcomes, slim.select("host").distinct(), suffixes), "url-reputation")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    return slim.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, learned).alias("verdict"), "mean", "bound"
    )


def op4_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Contract query: host, path, rule and verdict of every page, with the posterior's mean and bound to nine digits."""
    found = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumns({c: F.round(c, 9) for c in ("mean", "bound")})


def _level_sql(name: str, table: str) -> str:
    return f"""
{name}_a AS (SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * n)::DOUBLE AS n2 FROM {table} WHERE n > 0),
{name}_v AS (SELECT sum(t.n * pow(t.k::DOUBLE / t.n - a.k / a.n, 2)) AS spread FROM {table} t, {name}_a a WHERE t.n > 0),
{name} AS (SELECT CASE WHEN g IS NULL OR g < 2 OR k <= 0 OR k >= n THEN {DEFAULT_STRENGTH} ELSE (1 - rho) / rho END AS s FROM (
  SELECT a.*, least(greatest((spread - (g - 1) * k / n * (1 - k / n)) / (k / n * (1 - k / n) * (n - n2 / n - (g - 1))), 0.001), 0.5) AS rho
  FROM {name}_a a, {name}_v))"""


def _digamma_sql(x: str) -> str:
    y = f"({x} + {STEPS})"
    return f"ln{y} - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - " + " - ".join(f"1 / ({x} + {i})" for i in range(STEPS))


def _trigamma_sql(x: str) -> str:
    y = f"({x} + {STEPS})"
    return f"1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + " + " + ".join(f"1 / pow({x} + {i}, 2)" for i in range(STEPS))


OP4_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (
  SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
o AS (
  SELECT p.host, l.bad FROM (SELECT host, try_cast(regexp_extract(path, '^/[^/]*/([0-9]{{1,15}})', 1) AS BIGINT) AS doc FROM p) p
  JOIN l ON p.doc = l.doc),
v AS (
  SELECT host, bare, string_split(bare, '.') AS w, regexp_matches(bare, '^(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') OR starts_with(bare, '[') AS address
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p)),
e AS (
  SELECT host, bare, address, w, CASE WHEN array_to_string(w[greatest(len(w) - 1, 1):], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN 2 ELSE 1 END AS ends FROM v),
g AS (
  SELECT host, CASE WHEN address THEN bare ELSE array_to_string(w[greatest(len(w) - ends, 1):], '.') END AS domain,
    CASE WHEN address THEN '' ELSE array_to_string(w[greatest(len(w) - ends + 1, 1):], '.') END AS suffix FROM e),
h AS (
  SELECT host, domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k
  FROM (SELECT host, 1 AS n, bad AS k FROM o UNION ALL SELECT DISTINCT host, 0, 0 FROM p) JOIN g USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY ALL),
m AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS m0 FROM s),{_level_sql("s1", "s")},{_level_sql("s2", "d")},{_level_sql("s3", "h")},
ms AS (SELECT suffix, (k + s1.s * m0) / (n + s1.s) AS m1 FROM s, s1, m),
md AS (SELECT domain, suffix, (k + s2.s * m1) / (n + s2.s) AS m2 FROM d JOIN ms USING (suffix), s2),
mh AS (SELECT host, k + s3.s * m2 AS a, n + s3.s - (k + s3.s * m2) AS b, (k + s3.s * m2) / (n + s3.s) AS mean FROM h JOIN md USING (domain, suffix), s3),
b AS (
  SELECT host, mean, 1 / (1 + exp(-({_digamma_sql("a")} - ({_digamma_sql("greatest(b, 1.0)")}) - {Z} * sqrt({_trigamma_sql("a")} + {_trigamma_sql("greatest(b, 1.0)")})))) AS bound FROM mh),
r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{h}', '{q}')" for a, h, q in RULES)}) AS r(action, rule_host, rule_path)),
f AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN b.bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  round(b.mean, 9) AS mean, round(b.bound, 9) AS bound
FROM p JOIN b USING (host) LEFT JOIN f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
"""
