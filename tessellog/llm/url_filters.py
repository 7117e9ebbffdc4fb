"""URL filtering by path rules and empirical-Bayes host reputation.

Rules decide first: a rule (host, path prefix) fits its host and every subdomain;
the longest fitting rule wins.  Everything else is judged by its host's reputation.
Labelled page outcomes are counted by host, registered domain and public suffix.  From
the top down each level's bad rate gets a beta
prior: its mean is the parent's posterior mean, its strength the method-of-moments
estimate from how much the level's members disagree beyond chance.  A host is
blocked if even the lower posterior bound of its bad rate exceeds ``MAX_BAD``.

A public suffix is one of ``SUFFIXES``, or one of ``SECOND_LEVEL`` under a country's two
letters, or a host's last name; a registered domain is the suffix and the name ahead of it.  User
and port do not count.  An address (IPv4, or IPv6 in brackets) is a domain and a suffix of its own.

Only built-in expressions run.  Outcomes are counted by host with map-side partial sums,
once, into a table; the levels above are sums of that table.  Pages meet their host's
verdict by broadcast if there are at most ``BROADCAST_HOSTS`` hosts, else in a join that deals a hot host to several tasks.

A null URL, or one without ``://``, has an empty host and path and is allowed.  A
host without labelled pages has its domain's rate as its posterior, so it is blocked if its domain is bad beyond doubt; where the
domain has none either, the suffix alone blocks nothing.  Without any label no host is blocked.  Several labels of one page count as one, bad if any is.  Repeated pages
are judged alike; tied rules cannot occur, as rule strings are distinct.  A very long URL is
read whole.  An empty table gives an empty result; of ``pages`` only page_id and url are read, whatever other columns there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, lower_ascii, written

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: A host is blocked if its bad rate's lower bound is above this.
MAX_BAD = 0.4
#: Posterior standard deviations below the mean at which the bound lies.
Z = 1.645


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        name = F.when(fits, rule_host + prefix).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


#: Names under which countries register domains; with any two letters after them they are public suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "govt", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Other public suffixes of two names, under which anyone can have a host.
SUFFIXES = ("github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "web.app", "pages.dev")


def suffix_pattern(second_level=SECOND_LEVEL, suffixes=SUFFIXES) -> str:
    """A pattern of a name's registered domain (group 1) and public suffix (group 2), or of an address alone."""
    two = "|".join([rf"(?:{'|'.join(second_level)})\.[a-z][a-z]", *(s.replace(".", r"\.") for s in suffixes)])
    return rf"((?:[^.]*\.)?({two}|[^.]*))$"


#: User, port and a final dot of a host.
NOT_NAME = r"^[^@]*@|:[0-9]*$|\.$"
ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"

# Reputation in SQL that Spark and DuckDB both run, one statement a level, from ``hosts`` (host, domain, suffix, n, bad).
# Rates of the parents' means; of the squared deviations, what chance does not explain; held within (0.001, 0.5).
_RHO = """greatest(0.001, least(0.5, coalesce((sum(n * (bad * 1.0 / n - m) * (bad * 1.0 / n - m)) - sum(m * (1 - m)))
  / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001)))"""
#: A level's rows with the parents' mean m and the level's rho.
_LEVEL = "(SELECT *, (SELECT {rho} FROM {rows} WHERE n > 0) AS rho FROM {rows})"
SUFFIX_IN = "SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.1) / (coalesce(sum(n), 0) + 1.0) FROM hosts) AS m FROM hosts GROUP BY suffix"
DOMAIN_IN = f"""SELECT d.*, s.m FROM (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain) d
JOIN (SELECT suffix, (bad + (1 / rho - 1) * m) / (n + (1 / rho - 1)) AS m FROM {_LEVEL.format(rho=_RHO, rows="suffix_in")} x) s ON d.suffix = s.suffix"""
HOST_IN = f"""SELECT h.host, h.n, h.bad, d.m, d.domain_n FROM hosts h
JOIN (SELECT domain, n AS domain_n, (bad + (1 / rho - 1) * m) / (n + (1 / rho - 1)) AS m FROM {_LEVEL.format(rho=_RHO, rows="domain_in")} x) d ON h.domain = d.domain"""
VERDICTS = f"""SELECT host, n AS host_labelled, bad AS host_bad,
  CASE WHEN host <> '' AND domain_n > 0 AND a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS reputation
FROM (SELECT host, n, bad, domain_n, bad + (1 / rho - 1) * m AS a, n - bad + (1 / rho - 1) * (1 - m) AS b FROM {_LEVEL.format(rho=_RHO, rows="host_in")} x) y"""
#: Up to this many hosts are broadcast to the pages (about 100 bytes each); beyond, the join is shuffled.
BROADCAST_HOSTS = 100_000


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, second_level=SECOND_LEVEL, suffixes=SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_labelled, host_bad) for every row of ``pages``.

    ``outcomes`` has page_id and bad (0 or 1; null: no outcome).
    """
    spark = pages.sparkSession
    own = pages.select("page_id", "url")
    parsed = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    name, pattern = F.regexp_replace("host", NOT_NAME, ""), suffix_pattern(second_level, suffixes)
    part = lambda group: F.when(F.col("name").rlike(ADDRESS), F.col("name")).otherwise(F.regexp_extract("name", pattern, group))
    counted = parsed.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    hosts = written(counted.withColumn("name", name).select("host", part(1).alias("domain"), part(2).alias("suffix"), "n", "bad", "pages"), "hosts")
    above = {}
    for level, sql in (("suffix_in", SUFFIX_IN), ("domain_in", DOMAIN_IN), ("host_in", HOST_IN)):
        above[level] = written(_over(spark, sql, above, hosts), level)
    verdicts = _over(spark, VERDICTS, above, hosts)
    n = hosts.count()
    judged = parsed.join(F.broadcast(verdicts), "host", "left") if n <= BROADCAST_HOSTS else dealt(parsed, verdicts, ["host"], "left", counts=hosts.select("host", F.col("pages").alias("n")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation", F.lit("allow")).alias("verdict"), "host_labelled", "host_bad")


def _over(spark, sql: str, levels: dict[str, DataFrame], hosts: DataFrame) -> DataFrame:
    frames = {"hosts": hosts, **levels}
    for name in frames:
        sql = re.sub(rf"(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **{name: df for name, df in frames.items() if f"{{{name}}}" in sql})


_RULE_CASES = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in _RULE_CASES]
SQL = f"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(host, '{NOT_NAME}', '', 'g') AS name
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (SELECT host, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE regexp_extract(name, '{suffix_pattern()}', 1) END AS domain,
  CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name ELSE regexp_extract(name, '{suffix_pattern()}', 2) END AS suffix, n, bad FROM counted),
suffix_in AS ({SUFFIX_IN}), domain_in AS ({DOMAIN_IN}), host_in AS ({HOST_IN}), verdicts AS ({VERDICTS})
SELECT page_id, host, path,
  CASE {' '.join(f"{fits} THEN '{h}{p}'" for fits, (_, h, p) in zip(_FITS, _RULE_CASES, strict=True))} END AS rule,
  CASE {' '.join(f"{fits} THEN '{v}'" for fits, (v, _, _) in zip(_FITS, _RULE_CASES, strict=True))} ELSE coalesce(reputation, 'allow') END AS verdict,
  host_labelled::BIGINT AS host_labelled, host_bad::BIGINT AS host_bad
FROM parsed LEFT JOIN verdicts USING (host)
"""
