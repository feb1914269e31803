"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad: quality 0 or toxic 1) are counted by host, registered domain (one name more than the suffix) and suffix
(the last name, or the last two where registries give out names below them: SUFFIXES). User and port are no part of these. Each level's bad rates are beta-binomial: its prior is centred on the posterior mean of the level above, and
its strength is fitted by moments over all groups of the level, so a host with little evidence is shrunk to its domain, a
domain to its suffix, a suffix to the whole. A page is blocked where the lower bound of its host's posterior (mean less Z
standard deviations) has over RATIO times the odds of the mean over all labelled pages, so what is usual in the corpus is never blocked and the limit
fits a corpus of any rate; hosts without labels take the posterior of the nearest level above that has some. The result says which level that was.
Fixed rules (host and path prefix) come first; the longest that fits decides.

A page's label is that of the document whose number stands in its path (the first run of digits that follows a slash).

Very long urls are read whole. Null url, or one without "://": empty host and path, no rule, judged at the top level. Null labels count as good. Repeated pages
come back as often as they stand; repeated labels of a document count as one (bad if any is). Empty tables: no rows, or no
evidence (all pages without a rule are allowed). Other columns of pages are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, table, written

#: Fixed rules: host, path prefix, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Suffixes of two names below which names are registered.
SUFFIXES = (
    "co.uk org.uk gov.uk ac.uk net.uk com.br org.br gov.br net.br edu.br leg.br mp.br com.au net.au org.au gov.au edu.au co.nz org.nz co.za org.za co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr "
    "co.in org.in gov.in com.cn org.cn gov.cn com.tw com.hk com.sg com.my co.id com.mx org.mx gob.mx com.ar gob.ar com.co com.pe com.ve com.ec com.uy com.tr gov.tr com.ua com.pl co.il com.eg com.sa com.pt"
).split()
RATIO, Z, STRONGEST = 1.5, 1.645, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url) -> tuple:
    """host and path of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES) -> tuple:
    """The longest rule that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def levels_of(host) -> dict:
    """host, domain and suffix of a host for its reputation."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$")
    two = F.substring_index(name, ".", -2)
    long = two.isin(SUFFIXES)
    # an address has no names above it
    domain, suffix = F.when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(name, ".", -1))
    return {"site": name, "domain": F.when(address, name).otherwise(domain), "suffix": F.when(address, name).otherwise(suffix)}


def _strength(groups: DataFrame, centre: str | float) -> float:
    """Prior strength of a level by moments: n labelled pages and k bad ones of each group, and the mean above it."""
    m = F.lit(centre) if isinstance(centre, float) else F.col(centre)
    s = groups.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2)), F.sum(m * (1 - m)), F.sum(F.col("n") * m * (1 - m)),
    ).first()
    if not s[0] or s[0] < 2 or s[1] <= 0 or not s[1] - s[2] / s[1]:
        return STRONGEST
    within, spread = s[4] * (s[0] - 1) / s[0], s[5] / s[1]
    between = (s[3] - within) / (s[1] - s[2] / s[1])
    return STRONGEST if between <= 0 else float(min(STRONGEST, max(1.0, spread / between - 1)))


def reputation(outcomes: DataFrame, z: float = Z) -> tuple[list[DataFrame], float, float]:
    """outcomes: site, domain, suffix, bad (0 or 1). Tables (level name, mean, bound) of site, domain and suffix; mean and bound at the top."""
    hosts = written(outcomes.groupBy("site", "domain", "suffix").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("k")))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
    a, b = total[1] + 0.5, total[0] - total[1] + 0.5  # Jeffreys' prior at the top
    whole = above = a / (a + b)
    key, out = None, []
    top = above - z * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
    found = None
    for name in ("suffix", "domain", "site"):
        groups = hosts.groupBy(name, *([key] if key else [])).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        groups = groups.join(found.select(key, F.col("mean").alias("m")), key) if key else groups.withColumn("m", F.lit(above))
        groups = written(groups)
        s = _strength(groups, "m")
        a, b = F.col("k") + F.col("m") * s, F.col("n") - F.col("k") + (1 - F.col("m")) * s
        found = groups.select(name, (a / (a + b)).alias("mean"), (a / (a + b) - z * F.sqrt(a * b / F.pow(a + b, 2) / (a + b + 1))).alias("bound"))
        out.append(found)
        key = name
    return out[::-1], whole, top


def limit_of(mean: float, ratio: float = RATIO) -> float:
    """The rate that has `ratio` times the odds of the mean."""
    odds = ratio * mean / (1 - mean)
    return odds / (1 + odds)


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, ratio: float = RATIO, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; and the level whose posterior counts for it, with mean and lower bound."""
    host, path = parts_of(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns(levels_of(F.col("host")))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    labels = labels.groupBy(F.col("doc_id").alias("doc")).agg(bad.alias("bad"))
    named = pages.select("site", "domain", "suffix", F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint)").alias("doc")).filter("doc is not null")
    (hosts, domains, suffixes), mean, top = reputation(named.join(labels, "doc").select("site", "domain", "suffix", "bad"), z)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "_said": verdict})
    levels = ("site", hosts), ("domain", domains), ("suffix", suffixes)
    for name, found in levels:
        pages = pages.join(small_enough(found.select(name, F.struct(F.lit(name).alias("level"), "mean", "bound").alias(f"_{name}")), 100_000), name, "left")
    whole = F.struct(F.lit("top").alias("level"), F.lit(mean).alias("mean"), F.lit(top).alias("bound"))
    pages = pages.withColumn("_own", F.coalesce("_site", "_domain", "_suffix", whole))
    own = F.when(F.col("_own.bound") > limit_of(mean, ratio), "block").otherwise("allow")
    return pages.select("page_id", "host", "path", "rule", F.coalesce("_said", own).alias("verdict"), "_own.level", F.round("_own.mean", 6).alias("mean"), F.round("_own.bound", 6).alias("bound"))


def op7_url_reputation(spark, sf_dir) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _level_sql(name: str, parent: str, mean: str) -> str:
    """SQL of one level: groups g_<name> with their prior mean m, the strength, and the posterior p_<name>."""
    return f"""
g_{name} AS (SELECT hosts.{name}, sum(n) AS n, sum(k) AS k, any_value({mean}) AS m FROM hosts {parent} GROUP BY hosts.{name}),
c_{name} AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(n * (k / n - m) ** 2) AS sq, sum(m * (1 - m)) AS w, sum(n * m * (1 - m)) AS sp FROM g_{name}),
b_{name} AS (SELECT *, CASE WHEN g < 2 OR n - nn / n = 0 THEN 0 ELSE (sq - w * (g - 1) / g) / (n - nn / n) END AS between_ FROM c_{name}),
s_{name} AS (SELECT CASE WHEN between_ <= 0 THEN {STRONGEST} ELSE least({STRONGEST}, greatest(1.0, sp / n / between_ - 1)) END AS s FROM b_{name}),
a_{name} AS (SELECT {name}, k + m * s AS a, n - k + (1 - m) * s AS b FROM g_{name}, s_{name}),
p_{name} AS (SELECT {name}, a / (a + b) AS mean, a / (a + b) - {Z} * sqrt(a * b / (a + b) ** 2 / (a + b + 1)) AS bound FROM a_{name}),"""


_RULE_SQL = [
    " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{x}'" for h, p, x in ((h, p, (h + p, v)[i]) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))))
    for i in (0, 1)
]
_SUFFIX_SQL = ", ".join(f"'{x}'" for x in SUFFIXES)
ORACLE_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), named AS (
  SELECT *, CASE WHEN plain_address THEN site WHEN two IN ({_SUFFIX_SQL}) THEN array_to_string(string_split(site, '.')[-3:], '.') ELSE two END AS domain,
         CASE WHEN plain_address THEN site WHEN two IN ({_SUFFIX_SQL}) THEN two ELSE string_split(site, '.')[-1] END AS suffix,
         CASE {_RULE_SQL[0]} END AS rule, CASE {_RULE_SQL[1]} END AS said, TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) AS doc
  FROM (SELECT *, array_to_string(string_split(site, '.')[-2:], '.') AS two, regexp_matches(site, '^(\\[.*\\]|[0-9]+(\\.[0-9]+){{3}})$') AS plain_address FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM parsed))
), outcome AS (
  SELECT doc_id AS doc, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT site, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS k FROM named JOIN outcome USING (doc) GROUP BY ALL
), whole AS (SELECT coalesce(sum(k), 0) + 0.5 AS a, coalesce(sum(n) - sum(k), 0) + 0.5 AS b FROM hosts),
top AS (SELECT a / (a + b) AS mean, a / (a + b) - {Z} * sqrt(a * b / (a + b) ** 2 / (a + b + 1)) AS bound FROM whole),
{_level_sql("suffix", "CROSS JOIN top", "top.mean")}
{_level_sql("domain", "JOIN p_suffix USING (suffix)", "p_suffix.mean")}
{_level_sql("site", "JOIN p_domain USING (domain)", "p_domain.mean")}
fin AS (
  SELECT page_id, host, path, rule, said, CASE WHEN p_site.bound IS NOT NULL THEN 'site' WHEN p_domain.bound IS NOT NULL THEN 'domain' WHEN p_suffix.bound IS NOT NULL THEN 'suffix' ELSE 'top' END AS level,
         coalesce(p_site.mean, p_domain.mean, p_suffix.mean, top.mean) AS mean, coalesce(p_site.bound, p_domain.bound, p_suffix.bound, top.bound) AS bound, {RATIO} * top.mean / (1 - top.mean) AS odds
  FROM named CROSS JOIN top LEFT JOIN p_site USING (site) LEFT JOIN p_domain USING (domain) LEFT JOIN p_suffix USING (suffix)
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound > odds / (1 + odds) THEN 'block' ELSE 'allow' END) AS verdict, level, round(mean, 6) AS mean, round(bound, 6) AS bound FROM fin
"""
