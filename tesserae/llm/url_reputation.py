"""Host reputation by empirical Bayes, from DataFrame functions only.

Labelled pages give each host a count of pages and of bad ones. A beta prior comes from the level above: suffix under
all pages, registered domain under its suffix, host under its domain. How much a prior weighs is fitted for each level
by the moments of the beta-binomial: the more the shares of a level's members scatter, the less they are shrunk. A page
without a rule is blocked when a low quantile of the posterior of its host's share of bad pages is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (host, path, verdict), fixed by the task.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Pages that a prior weighs at least and at most, and where a level says nothing about it.
LEAST_STRENGTH, MOST_STRENGTH, STRENGTH = 1.0, 1000.0, 8.0
#: Deviation of the normal distribution's lower 10 % quantile, that of the posterior which is the bound; share of bad
#: pages to block from.
DEVIATION = 1.2815515655
THRESHOLD = 0.5
#: A host with more than one in so many pages is joined by broadcast: there are fewer such hosts than this.
HOT = 1000
#: Public suffixes of two labels that are common; other suffixes are the last label.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "co.za", "co.in",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.br", "com.ar", "com.mx", "com.tr", "com.cn", "com.tw", "com.sg",
)
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path as columns; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOW), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without what names a user or a port."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(
        two.isin(*SUFFIXES),
        F.substring_index(name, ".", -3),
    ).otherwise(two), F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def strength(members: DataFrame, n: str, k: str, mean: str) -> float:
    """What the prior weighs on a level, from (pages, bad pages, mean of the level above) of its members.

    For beta-binomial counts the squared differences sum to n m (1 - m) (1 + (n - 1) / (strength + 1)).
    """
    n, k, m = F.col(n), F.col(k), F.col(mean)
    plain, more = n * m * (1 - m), n * (n - 1) * m * (1 - m)
    rho = (F.sum((k - n * m) * (k - n * m)) - F.sum(plain)) / F.sum(more)
    fitted = F.when(
        F.sum(more) > 0,
        F.when(rho > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), 1 / rho - 1))).otherwise(F.lit(MOST_STRENGTH)),
    )
    return members.agg(F.round(F.coalesce(fitted, F.lit(STRENGTH)), 4)).first()[0]


def low_quantile(a: Column, b: Column, deviation: float = DEVIATION) -> Column:
    """The quantile of a beta distribution at a normal deviation below the middle, by the cube root of the F ratio.

    a and b count as 0.5 at least, where the formula still holds.
    """
    a, b, z = F.greatest(a, F.lit(0.5)), F.greatest(b, F.lit(0.5)), deviation**2
    v1, v2 = 1 / (9 * a), 1 / (9 * b)
    c1, c2 = 1 - v1, 1 - v2
    lead = c2 * c2 - z * v2
    root = F.greatest(F.lit(0.0), (c1 * c2 - F.sqrt(F.greatest(F.lit(0.0), c1 * c1 * c2 * c2 - lead * (c1 * c1 - z * v1)))) / lead)
    ratio = root * root * root
    return a * ratio / (a * ratio + b)


def reputation(pages: DataFrame, *, deviation: float = DEVIATION) -> DataFrame:
    """host, whether it is hot, mean and bound of its share of bad pages, from pages with host and bad (1, 0, or null: not labelled).

    Counts are summed by host first and kept; hosts are summed to domains and domains to suffixes, so that no level
    collects pages and they are read once. The driver gets one number for each level.
    """
    hosts = pages.groupBy("host").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("bad").alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("k"),
    )
    domain, suffix = levels(F.col("host"))
    hosts = stored(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))

    def shrunk(k: str, n: str, m: str, s: float) -> Column:
        return (F.col(k) + F.col(m) * s) / (F.col(n) + s)

    n, k, total = hosts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "k", "rows")]).first()
    suffixes = suffixes.withColumn("m0", F.lit((k + 0.5) / (n + 1.0)))
    suffixes = suffixes.withColumn("m1", shrunk("sk", "sn", "m0", strength(suffixes, "sn", "sk", "m0"))).select("suffix", "m1")
    domains = domains.join(suffixes, "suffix")
    domains = domains.withColumn("m2", shrunk("dk", "dn", "m1", strength(domains, "dn", "dk", "m1"))).select("domain", "suffix", "m2")
    hosts = hosts.join(domains, ["domain", "suffix"])
    s = strength(hosts, "n", "k", "m2")
    hosts = hosts.withColumn("mean", shrunk("k", "n", "m2", s))
    bound = low_quantile(F.col("k") + F.col("m2") * s, F.col("n") - F.col("k") + (1 - F.col("m2")) * s, deviation)
    return hosts.select("host", (F.col("rows") * HOT > total).alias("hot"), "mean", bound.alias("bound"))


def judged(
    pages: DataFrame,
    *,
    rules=RULES,
    outcomes: DataFrame | None = None,
    threshold: float = THRESHOLD,
    deviation: float = DEVIATION,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (posterior mean), bound for each row of pages.

    outcomes: (page_id, bad) labels; without it, the pages that a rule decides are the labelled ones. A null url has
    empty host and path, which is a host like any other. Repeated rows count and come back each; nothing is dropped;
    columns of other names, or of the names above, don't matter. An empty table gives an empty result.

    The few hosts with a large share of all pages get their values by broadcast, and their rows are dealt by page in
    the join for the other hosts, so that no task holds a host's pages.
    """
    host, path = parts(F.col(url_col))
    page = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    page = page.withColumn("_rule", by_rule(F.col("host"), F.col("path"), rules))
    if outcomes is None:
        labelled = page.select("host", F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0).alias("bad"))
    else:
        marks = outcomes.groupBy(F.col("page_id").alias("_page")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
        labelled = page.join(marks, page["page_id"] == F.col("_page"), "left").select("host", "bad")
    known = reputation(labelled, deviation=deviation)
    hot = known.where("hot").select(F.col("host").alias("_hot"), F.col("mean").alias("_hot_mean"), F.col("bound").alias("_hot_bound"))
    out = page.join(F.broadcast(hot), page["host"] == F.col("_hot"), "left")
    # Hosts hold no blank after a `/`-free start, so a key with one meets no host.
    key = F.when(F.col("_hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("/ "), F.xxhash64("page_id", "path").cast("string")))
    out = out.withColumn("_key", key).join(
        known.select(F.col("host").alias("_host"), "mean", "bound"),
        F.col("_key") == F.col("_host"),
        "left",
    )
    out = out.withColumns({"mean": F.coalesce("_hot_mean", "mean"), "bound": F.coalesce("_hot_bound", "bound")})
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") > threshold, "block").otherwise("allow"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        verdict.alias("verdict"),
        F.round("mean", 6).alias("reputation"),
        F.round("bound", 6).alias("bound"),
    )


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


SQL_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h,
    p,
    _ in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
) + " END"
_TWO = "array_to_string(list_slice(labels, -2, -1), '.')"
_IS_TWO = f"{_TWO} IN ({', '.join(repr(x) for x in SUFFIXES)})"


def _strength_sql(name: str, rows: str, n: str, k: str, m: str) -> str:
    plain = f"sum({n} * {m} * (1 - {m}))"
    more = f"sum({n} * ({n} - 1) * {m} * (1 - {m}))"
    rho = f"((sum(({k} - {n} * {m}) * ({k} - {n} * {m})) - {plain}) / {more})"
    return f"""{name} AS (SELECT round(coalesce(CASE WHEN {more} > 0 THEN CASE WHEN {rho} > 0 THEN
    least({MOST_STRENGTH}::double, greatest({LEAST_STRENGTH}::double, 1 / {rho} - 1)) ELSE {MOST_STRENGTH}::double END END, {STRENGTH}::double), 4) AS {name} FROM {rows})"""


_Z2 = DEVIATION**2
SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), page AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOW}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, {SQL_RULE} AS rule FROM page
), marked AS (
  SELECT *, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)} END AS decided FROM ruled
), counts AS (
  SELECT host, count(decided) AS n, count(*) FILTER (decided = 'block') AS k,
         string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels FROM marked GROUP BY host
), hosts AS (
  SELECT host, n, k, CASE WHEN {_IS_TWO} THEN array_to_string(list_slice(labels, -3, -1), '.') ELSE {_TWO} END AS domain,
         CASE WHEN {_IS_TWO} THEN {_TWO} ELSE labels[-1] END AS suffix FROM counts
), domains AS (
  SELECT domain, suffix, sum(n)::double AS dn, sum(k)::double AS dk FROM hosts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM domains GROUP BY suffix
), everything AS (
  SELECT (coalesce(sum(sk), 0) + 0.5::double) / (coalesce(sum(sn), 0) + 1.0::double) AS m0 FROM suffixes
), u0 AS (SELECT * FROM suffixes, everything), {_strength_sql("s1", "u0", "sn", "sk", "m0")},
u1 AS (
  SELECT domains.*, (sk + m0 * s1) / (sn + s1) AS m1 FROM domains JOIN u0 USING (suffix), s1
), {_strength_sql("s2", "u1", "dn", "dk", "m1")},
u2 AS (
  SELECT hosts.host, n::double AS n, k::double AS k, (dk + m1 * s2) / (dn + s2) AS m2 FROM hosts JOIN u1 USING (domain, suffix), s2
), {_strength_sql("s3", "u2", "n", "k", "m2")},
posterior AS (
  SELECT host, (k + m2 * s3) / (n + s3) AS mean, greatest(k + m2 * s3, 0.5::double) AS a, greatest(n - k + (1 - m2) * s3, 0.5::double) AS b FROM u2, s3
), roots AS (
  SELECT host, mean, a, b, 1 - 1 / (9 * a) AS c1, 1 - 1 / (9 * b) AS c2, 1 / (9 * a) AS v1, 1 / (9 * b) AS v2 FROM posterior
), ratios AS (
  SELECT host, mean, a, b, greatest(0.0::double, (c1 * c2 - sqrt(greatest(0.0::double, c1 * c1 * c2 * c2 - (c2 * c2 - {_Z2}::double * v2) * (c1 * c1 - {_Z2}::double * v1)))) / (c2 * c2 - {_Z2}::double * v2)) AS f FROM roots
), bounds AS (
  SELECT host, mean, a * f * f * f / (a * f * f * f + b) AS bound FROM ratios
)
SELECT page_id, marked.host AS host, path, rule,
       coalesce(decided, CASE WHEN bound > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS reputation, round(bound, 6) AS bound
FROM marked LEFT JOIN bounds ON marked.host = bounds.host
"""
