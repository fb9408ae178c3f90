"""URL filters: rules first, then an empirical-Bayes reputation of hosts.

Labelled pages are counted by host with map-side sums, hosts roll up to registered domains and those to suffixes.  Each
level is a beta-binomial whose prior mean is the posterior mean of the level above and whose prior strength is found by
the method of moments over that level's groups, so a host with few labelled pages leans on its domain, one with none
stands on it, and one with many speaks for itself.  User names and ports are no part of a name; an address is its own
domain and suffix; a suffix has two labels where the last is a country's and the one before it is in SECOND.  A host is blocked if the lower bound of its bad-page rate (posterior mean - z posterior standard
deviations) is above `limit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hot_keys, join_hot, scratched, written

#: (host, path, verdict) of the contract.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LIMIT, Z = 0.25, 1.0
#: Labels under which countries register names.
SECOND = ("ac", "co", "com", "edu", "gov", "go", "ne", "net", "or", "org")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def registered(host: Column) -> tuple[Column, Column]:
    """The registered domain and the public suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    address = name.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[.*\]$")
    two = name.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$")
    pick = lambda n: F.when(address, name).when(two, F.substring_index(name, ".", -n - 1)).otherwise(F.substring_index(name, ".", -n))
    return pick(2), pick(1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits (null if none) and its verdict; of several, the longest."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


@scratched
def host_reputation(outcomes: DataFrame, limit: float = LIMIT, z: float = Z, hosts: DataFrame | None = None) -> DataFrame:
    """outcomes: host, bad (0 or 1; null rows are not labelled); hosts: host, further ones to score.  Returns for each
    labelled or further host: host, domain, suffix, n, bad, rate (posterior mean), bound, blocked (see registered for
    domain and suffix).  The empty host is a group like any other; a null one is left out.  A host without a labelled page
    has n = 0 and stands on its domain, else its suffix, else the total.  No labelled row gives no rows."""
    count = lambda c: F.sum(c).alias(c)
    level = outcomes.where(F.col("bad").isNotNull()).select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    if hosts is not None:
        level = level.unionByName(hosts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")))
    level = level.groupBy("host").agg(count("n"), count("bad"))
    domain, suffix = registered(F.col("host"))
    hosts = written(level.where(F.col("host").isNotNull()).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n > 0").select(((F.col("bad") + 0.5) / (F.col("n") + 1.0)).alias("up"))

    def strength(groups: DataFrame) -> DataFrame:
        """Prior strength by moments: p (1 - p) / var - 1, var the spread of rates of labelled groups beyond that of
        binomial draws."""
        groups = groups.where("n > 0")
        p = F.sum("bad") / F.sum("n")
        spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) / F.sum("n") - p * p
        var = spread - p * (1 - p) * F.count(F.lit(1)) / F.sum("n")
        k = F.when(var > 0, F.least(F.lit(200.0), F.greatest(F.lit(2.0), p * (1 - p) / var - 1))).otherwise(F.lit(200.0))
        return groups.agg(k.alias("k"))

    def shrunk(groups: DataFrame, prior: DataFrame, on: str | None) -> DataFrame:
        both = groups.join(prior, on) if on else groups.crossJoin(F.broadcast(prior))  # one row
        both = both.crossJoin(F.broadcast(strength(groups)))  # one row
        return both.withColumns({"a": F.col("bad") + F.col("k") * F.col("up"), "b": F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("up"))})

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("up")
    s = shrunk(suffixes, total, None).select("suffix", mean)
    d = shrunk(domains, written(s, "suffixes"), "suffix").select("domain", mean)
    h = shrunk(hosts, written(d, "domains"), "domain")
    ab = F.col("a") + F.col("b")
    return h.withColumn("rate", F.col("a") / ab).withColumn(
        "bound", F.col("rate") - z * F.sqrt(F.col("a") * F.col("b") / (ab * ab * (ab + 1)))).select(
        "host", "domain", "suffix", "n", "bad", "rate", "bound", (F.col("bound") > limit).alias("blocked"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns for each row: id, host, path, rule (null if none fits), verdict (the rule's, else block or allow by
    host_reputation, which scores every host of pages; all are allowed if nothing is labelled).  A null url has an empty host and path; repeated rows
    are judged alike."""
    out = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = host_reputation(outcomes, limit, z, out.select("host")).select("host", "blocked")
    out = join_hot(out, hosts, ["host"], hot_keys(out, ["host"]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad of the pages that have a label of the same id: bad if it says low quality or toxic, null if it says
    neither nor; a page with several labels counts with each, rows without an id with none."""
    bad = F.when(F.coalesce("quality", "toxic").isNotNull(), ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    return (labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
            .join(pages.select("page_id", host_of(F.col("url")).alias("host")), "page_id").select("host", "bad"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return judge_urls(pages, labelled_outcomes(pages, labels))


def _fits(h: str, p: str) -> str:
    return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"


_RANKED = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
_K = """CASE WHEN {0} > 0 THEN least(200.0, greatest(2.0, p * (1 - p) / {0} - 1)) ELSE 200.0 END"""


def _strength(table: str) -> str:
    var = "(spread - p * (1 - p) * g / t)"
    return f"""SELECT {_K.format(var)} AS k FROM (
  SELECT sum(bad)::DOUBLE / sum(n) AS p, sum(n)::DOUBLE AS t, count(*)::DOUBLE AS g,
         sum(bad::DOUBLE * bad / n) / sum(n) - (sum(bad)::DOUBLE / sum(n)) * (sum(bad)::DOUBLE / sum(n)) AS spread FROM {table} WHERE n > 0)"""


OP7_SQL = rf"""
WITH pg AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM pg LEFT JOIN (
    SELECT doc_id, CASE WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT END AS bad FROM labels) ON doc_id = page_id GROUP BY host),
names AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS name FROM hosts),
parts AS (
  SELECT *, CASE WHEN regexp_matches(name, '^([0-9]+\.){{3}}[0-9]+$|^\[.*\]$') THEN 9 WHEN regexp_matches(name, '(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k,
         string_split(name, '.') AS l FROM names),
h1 AS (
  SELECT host, n, bad, CASE k WHEN 9 THEN name WHEN 2 THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE k WHEN 9 THEN name WHEN 2 THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM parts),
d1 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h1 GROUP BY suffix, domain),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d1 GROUP BY suffix),
ks AS ({_strength('s1')}), kd AS ({_strength('d1')}), kh AS ({_strength('h1')}),
s2 AS (SELECT suffix, (bad + k * up) / (n + k) AS up FROM s1, ks, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS up FROM hosts HAVING sum(n) > 0)),
d2 AS (SELECT domain, (bad + k * up) / (n + k) AS up FROM d1 JOIN s2 USING (suffix), kd),
h2 AS (SELECT host, bad + k * up AS a, n - bad + k * (1 - up) AS b FROM h1 JOIN d2 USING (domain), kh),
h3 AS (SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} AS blocked FROM h2),
r AS (
  SELECT pg.*, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _RANKED)} END AS rule,
         CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RANKED)} END AS said
  FROM pg)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN h3 ON r.host = h3.host
"""
