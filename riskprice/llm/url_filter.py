"""URL filter: host rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes (good or bad) are counted by host, registered domain, suffix and
overall. Each level's rate is shrunk towards the level above by a beta-binomial prior:
its mean is the parent's posterior mean, its strength is estimated from how much the
rates of that level's groups differ (method of moments), so a host with few labels
follows its domain and a host with many speaks for itself. A page without a rule is
allowed if the lower bound of its host's posterior (mean - z * sd) reaches ``min_good``.

Counts are built upwards from the hosts' counts, so pages are aggregated once, with
map-side partial aggregation; the only skewed step, bringing reputations back to the
pages of a hot host, is a plain equi-join that Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two parts under which names are registered, where the caller names no rules.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.za")
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0


class Rule(NamedTuple):
    verdict: str                # allow or block
    host: str
    path: str                   # begins with /

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; null or no ``://``: empty."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def suffix_rules(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """(name, kind) from lines in the format of public suffix lists: ``co.uk`` is a suffix,
    ``*.ck`` makes one of every name under ``ck``, ``!www.ck`` excepts a name from that;
    blank lines and what follows ``//`` or a space are skipped."""
    rules = set()
    for line in lines:
        rule = line.split("//")[0].split()
        if rule:
            name = rule[0].lower().strip(".")
            kind = "!" if name.startswith("!") else "*" if name.startswith("*.") else ""
            rules.add((name.removeprefix("!").removeprefix("*."), kind))
    return spark.createDataFrame(sorted(rules), "name string, kind string")


def with_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` (one row a host) with ``domain`` and ``suffix``. An exception gives the suffix
    one label shorter; else the longest rule that fits; without one it is the last label. The
    registered domain has one label more (a host that is a suffix is its own domain)."""
    labels = F.size(F.split("host", "[.]"))
    tails = hosts.select("host", labels.alias("labels"), F.explode(F.sequence(F.lit(1), labels)).alias("n")) \
                 .select("host", "labels", "n", F.expr("substring_index(host, '.', -n)").alias("name"))
    length = F.when(F.col("kind") == "!", F.col("n") - 1).when(F.col("kind") == "*", F.col("n") + 1).otherwise(F.col("n"))
    fitting = tails.join(rules, "name").withColumn("n", length).where("n <= labels") \
                   .groupBy("host").agg(F.max(F.when(F.col("kind") == "!", F.col("n"))).alias("excepted"), F.max("n").alias("longest")) \
                   .select(F.col("host").alias("_host"), F.coalesce("excepted", "longest").alias("_n"))
    found = hosts.join(fitting, F.col("host") == F.col("_host"), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return found.withColumns({"suffix": F.expr("substring_index(host, '.', -_n)"), "domain": F.expr("substring_index(host, '.', -(_n + 1))")}) \
                .drop("_host", "_n")


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits the host or a parent domain and
    begins the path; null if none does. Equally long rules: the first in the list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level: from the moments of its groups' rates around their
    parents' rates. ``groups``: n, good per group, and the parent's pn, pgood."""
    rate, up = F.try_divide("good", "n"), F.try_divide("pgood", "pn")
    noise, others = up * (1 - up), 1 - F.try_divide("n", "pn")
    r = groups.where("n > 0").agg(
        F.sum(F.col("n") * (rate - up) * (rate - up)).alias("spread"),
        F.sum(noise * others).alias("expected"),
        F.sum(noise * (F.col("n") - 1) * others).alias("excess")).first()
    if not r["excess"]:
        return MAX_STRENGTH                  # no group that could show a difference
    rho = (r["spread"] - r["expected"]) / r["excess"]
    return MAX_STRENGTH if rho <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / rho - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.64, suffixes: Iterable[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """(host, n, good, reputation, lower_bound) of every host of ``pages`` (page_id, host).
    ``suffixes``: rules of what names are registered under (``suffix_rules``).

    ``outcomes``: (page_id, good 0/1). Pages without an outcome count for nothing; without
    any outcome at all the overall prior is uniform. The overall rate is (good+1)/(n+2)."""
    known = outcomes.where("page_id IS NOT NULL AND good IN (0, 1)").groupBy("page_id").agg(F.min("good").alias("good")) \
                    .select(F.col("page_id").alias("_page"), "good")
    hosts = pages.join(known, F.col("page_id") == F.col("_page"), "left") \
                 .groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = common.cut(with_domains(common.cut(hosts), suffix_rules(pages.sparkSession, suffixes)))
    up = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = up(hosts, "suffix", "domain")
    endings = up(domains, "suffix")
    total = endings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    overall = (total["good"] + 1) / (total["n"] + 2)
    as_parent = lambda df, *keys: df.select(*keys, F.col("n").alias("pn"), F.col("good").alias("pgood"))
    k_suffix = _strength(endings.withColumns({"pn": F.lit(total["n"]), "pgood": F.lit(total["good"])}))
    k_domain = _strength(domains.join(as_parent(endings, "suffix"), "suffix"))
    k_host = _strength(hosts.join(as_parent(domains, "suffix", "domain"), ["suffix", "domain"]))

    def shrunk(mean, strength):
        return (mean * strength + F.col("good")) / (F.col("n") + strength)

    s = endings.select("suffix", shrunk(F.lit(overall), k_suffix).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"))
    h = hosts.join(d, ["suffix", "domain"]).withColumn("reputation", shrunk(F.col("domain_mean"), k_host))
    sd = F.sqrt(F.col("reputation") * (1 - F.col("reputation")) / (F.col("n") + k_host + 1))
    return h.select("host", "n", "good", "reputation", (F.col("reputation") - z * sd).alias("lower_bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_good: float = 0.5, z: float = 1.64,
               suffixes: Iterable[str] = TWO_PART_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. A null url, or one without
    ``://``, has an empty host and path, which is a host like any other. Repeated rows are
    judged alike; rows with a null page_id have no outcome. Other columns are not read."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = host_reputation(parsed, outcomes, z, suffixes).select(F.col("host").alias("_host"), F.col("lower_bound"))
    name, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("lower_bound") >= min_good, "allow").otherwise("block")
    return parsed.join(known, F.col("host") == F.col("_host"), "left") \
                 .select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def oracle(rules: list[Rule], min_good: float = 0.5, z: float = 1.64) -> str:
    """DuckDB SQL of judge_urls over ``pages`` with ``labels.quality`` by page id."""
    two = ", ".join(f"'{s}'" for s in TWO_PART_SUFFIXES)
    ordered = sorted(rules, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in ordered) + " END"

    def strength(groups):
        return f"""(SELECT CASE WHEN coalesce(excess, 0) = 0 OR spread <= expected THEN {MAX_STRENGTH}
          ELSE least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, excess / (spread - expected) - 1)) END FROM (SELECT
          sum(n * (good / n - pgood / pn) * (good / n - pgood / pn)) AS spread,
          sum(pgood / pn * (1 - pgood / pn) * (1 - n / pn)) AS expected,
          sum(pgood / pn * (1 - pgood / pn) * (n - 1) * (1 - n / pn)) AS excess FROM ({groups}) WHERE n > 0))"""

    return f"""WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
counts AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good
  FROM parsed LEFT JOIN known ON page_id = doc_id GROUP BY host),
named AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two, array_to_string(string_split(host, '.')[-3:], '.') AS three,
  string_split(host, '.')[-1] AS one FROM counts),
hosts AS (SELECT host, n, good, CASE WHEN two IN ({two}) THEN three ELSE two END AS domain,
  CASE WHEN two IN ({two}) THEN two ELSE one END AS suffix FROM named),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM suffixes),
k AS (SELECT {strength("SELECT s.n, s.good, t.n AS pn, t.good AS pgood FROM suffixes s, total t")} AS ks,
  {strength("SELECT d.n, d.good, s.n AS pn, s.good AS pgood FROM domains d JOIN suffixes s USING (suffix)")} AS kd,
  {strength("SELECT h.n, h.good, d.n AS pn, d.good AS pgood FROM hosts h JOIN domains d USING (suffix, domain)")} AS kh),
s AS (SELECT suffix, ((t.good + 1) / (t.n + 2) * ks + s.good) / (s.n + ks) AS mean FROM suffixes s, total t, k),
d AS (SELECT d.suffix, domain, (s.mean * kd + good) / (n + kd) AS mean FROM domains d JOIN s USING (suffix), k),
h AS (SELECT host, n, kh, (d.mean * kh + good) / (n + kh) AS rep FROM hosts JOIN d USING (suffix, domain), k),
bound AS (SELECT host, rep - {z} * sqrt(rep * (1 - rep) / (n + kh + 1)) AS low FROM h)
SELECT page_id, parsed.host, path, {pick(lambda r: r.name)} AS rule,
  coalesce({pick(lambda r: r.verdict)}, CASE WHEN low >= {min_good} THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed JOIN bound ON parsed.host = bound.host""".replace("(host = '", "(parsed.host = '").replace("ends_with(host,", "ends_with(parsed.host,")
