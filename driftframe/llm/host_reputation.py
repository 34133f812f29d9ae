"""URL filter: explicit rules, else the empirical-Bayes reputation of the host.

Pages with a known outcome (bad or not) are counted for each host; outcomes come as a table of labelled pages, or else
from the text of the page itself, never from its host's name. The rate of bad pages of a host is
shrunk towards that of its registered domain, that one towards its public suffix, and that one towards all
pages, each by a beta-binomial prior whose strength comes from how much the children of one level differ
(moment estimator). A host is blocked when a lower bound of its posterior rate exceeds the limit, so that a
host with few pages is judged by its parents.

Scale: one aggregation by host with map-side sums (a hot host is one row for each task) makes the table of hosts,
which is kept; domains and suffixes are sums of it, and what a level says of its prior is one row of sums. The pages
join the hosts without hints, so Spark broadcasts a small table of hosts and splits a hot host otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.llm.text import stored

#: (verdict, rule): host and path prefix, the longest rule wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels under which names are registered.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "com.br", "com.cn", "co.in", "com.mx", "com.tr", "co.kr")
#: Marks of junk text; a page with so many has a bad outcome.
JUNK = r"[#$%*]{3}|!!"
JUNK_MARKS = 5
#: Block when the posterior rate less Z standard deviations is over LIMIT.
LIMIT = 0.1
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix(name: Column) -> Column:
    """Public suffix of a host name without user and port."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL), two).otherwise(F.substring_index(name, ".", -1))


def domain(name: Column) -> Column:
    """Registered domain: the suffix and one label."""
    return F.when(F.substring_index(name, ".", -2).isin(*SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^[^@]*@", ""), r":[0-9]*$", "")


def rule(host_name: Column, url_path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, null if none does. Rules compile into one CASE, longest first."""
    found, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host_name == name) | F.endswith(host_name, F.lit("." + name))) & F.startswith(url_path, F.lit(slash + rest))
        found, says = F.when(fits, F.lit(text)).otherwise(found), F.when(fits, F.lit(verdict)).otherwise(says)
    return found, says


def outcome(html: Column) -> Column:
    """1 for a bad page, 0 for a good one."""
    return (F.coalesce(F.regexp_count(html, F.lit(JUNK)), F.lit(0)) >= JUNK_MARKS).cast("long")


def _level(children: DataFrame) -> tuple[DataFrame, float]:
    """Children (``n, bad`` and the parent's posterior ``up``) with their posterior ``mean``, and the strength of the
    beta prior under which children scatter about their parents as they do."""
    n, up = F.col("n"), F.col("up")
    rate = F.col("bad") / n
    s = children.agg(
        F.sum(n).cast("double").alias("all"), F.sum((n * n).cast("double")).alias("squares"), F.count(F.lit(1)).alias("k"),
        F.sum(n * (rate - up) * (rate - up)).alias("scatter"), F.sum(n * up * (1 - up)).alias("binomial"),
    ).first()
    strength = 1000.0
    if s["k"] and s["binomial"] and s["all"] * s["all"] > s["squares"]:
        spread = max(0.0, (s["scatter"] - (s["k"] - 1) * s["binomial"] / s["all"]) / (s["all"] - s["squares"] / s["all"]))
        rho = spread / (s["binomial"] / s["all"])
        strength = min(max(1 / rho - 1, 1.0), 1000.0) if rho else 1000.0
    return children.withColumn("mean", (strength * up + F.col("bad")) / (strength + n)), strength


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, mean, lower`` of every host. ``outcomes``: ``host, bad`` (0 or 1; null is not counted)."""
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    name = bare(F.col("host"))
    hosts = stored(hosts.withColumn("suffix", suffix(name)).withColumn("domain", domain(name)))
    domains = stored(hosts.groupBy("suffix", "domain").agg(*counts))
    suffixes = stored(domains.groupBy("suffix").agg(*counts))
    world = suffixes.agg((F.sum("bad") / F.sum("n")).alias("up")).first()["up"]
    s, _ = _level(suffixes.withColumn("up", F.lit(world).cast("double")))
    d, _ = _level(stored(domains.join(s.select("suffix", F.col("mean").alias("up")), "suffix")))
    h, strength = _level(stored(hosts.join(d.select("suffix", "domain", F.col("mean").alias("up")), ["suffix", "domain"])))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strength + F.col("n") + 1))
    return h.select("host", "n", "bad", "mean", (F.col("mean") - Z * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict, reputation`` for every row of ``pages`` (``page_id, url, html``).

    ``outcomes``: ``page_id, bad`` of labelled pages, the worst if a page has several; pages without one, or with a
    null, don't count. Without ``outcomes`` a page's own text tells. A null url, or one without ``://``, has an empty
    host, path and no outcome; without a rule it is allowed. A null html has no marks of junk. Repeated rows count as
    further pages and each have their row. An empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    bad = outcome(F.col("html").cast("string")) if outcomes is None else F.lit(None).cast("long")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), bad.alias("bad"))
    if outcomes is not None:
        known = outcomes.groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("long")).alias("bad"))
        own = own.drop("bad").join(known, "page_id", "left")
    rep = reputation(own.select("host", F.when(F.col("host") != "", F.col("bad")).alias("bad")))
    found, says = rule(F.col("host"), F.col("path"), rules)
    joined = own.drop("bad").join(rep.select("host", "mean", "lower"), "host", "left")
    verdict = F.coalesce(says, F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", found.alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("reputation"))


def sql(rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> str:
    """The same in DuckDB SQL, over ``pages``."""
    case = {"rule": [], "verdict": []}
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + rest}')"
        case["rule"].append(f"when {fits} then '{text}'")
        case["verdict"].append(f"when {fits} then '{verdict}'")
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)

    def level(own: str, children: str) -> str:
        return f"""
{own}_v as (select least(greatest(coalesce(1 / nullif(greatest((scatter - (k - 1) * binomial / al) / nullif(al - sq / al, 0), 0) / nullif(binomial / al, 0), 0) - 1, 1000.0), 1.0), 1000.0) as strength
  from (select sum(n)::double as al, sum((n * n)::double) as sq, count(*) as k, sum(n * (bad / n - up) * (bad / n - up)) as scatter, sum(n * up * (1 - up)) as binomial from {children})),
{own} as (select *, (strength * up + bad) / (strength + n) as mean from {children}, {own}_v)"""

    return rf"""
with r as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
o as (select host, (coalesce(len(regexp_extract_all(html, '{JUNK}')), 0) >= {JUNK_MARKS})::bigint as bad from p where host <> ''),
c as (select host, count(*)::bigint as n, sum(bad)::bigint as bad, string_split(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '.') as l from o group by host),
h0 as (select host, n, bad, case when array_to_string(l[-2:], '.') in ({second}) then array_to_string(l[-2:], '.') else l[-1] end as suffix,
  case when array_to_string(l[-2:], '.') in ({second}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from c),
d0 as (select suffix, domain, sum(n)::bigint as n, sum(bad)::bigint as bad from h0 group by all),
s0 as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from d0 group by all),
s1 as (select *, (select sum(bad) / sum(n) from s0) as up from s0), {level("s", "s1")},
d1 as (select d0.*, s.mean as up from d0 join s using (suffix)), {level("d", "d1")},
h1 as (select h0.*, d.mean as up from h0 join d using (suffix, domain)), {level("h", "h1")}
select page_id, host, path, case {" ".join(case["rule"])} end as rule,
  coalesce(case {" ".join(case["verdict"])} end, case when mean - {Z} * sqrt(mean * (1 - mean) / (strength + n + 1)) > {limit} then 'block' else 'allow' end) as verdict,
  round(mean, 6) as reputation from p left join h using (host)"""
