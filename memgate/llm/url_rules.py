"""URL filters: rules for hosts and paths, and an empirical-Bayes reputation of hosts where no rule speaks. DataFrame functions only.

A rule `host/path` fits its host and all subdomains when the url's path starts with the rule's; the longest wins. Rules
are looked up by hashing: a url's host suffixes (bounded by its labels) meet the rules of equal host.

Reputation: pages with a known outcome (here: judged by a rule) are counted by host, registered domain and suffix.
The rate of blocked pages is shrunk level by level with beta-binomial priors: suffix towards the overall rate, domain
towards its suffix, host towards its domain; each level's prior weight is fitted by moments. A page without a rule is
blocked when the lower bound of its host's posterior, mean - 2 sd, passes `limit`.

Defined cases: null urls and urls without `://` have empty host and path and no host reputation beyond the overall
rate; a host of one label is its own domain and suffix; repeated rows are judged one by one; of rules of equal length the
first by name wins; urls of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgate.llm._shared import materialize

#: The rules of the query: (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Public suffixes of two labels under which domains are registered.
SUFFIXES = tuple("ac.uk co.uk gov.uk org.uk com.au net.au org.au edu.au co.nz org.nz co.jp ne.jp or.jp ac.jp com.br org.br gov.br co.in org.in com.cn net.cn org.cn edu.cn com.mx com.ar co.za com.tr com.tw org.tw com.sg com.hk co.kr or.kr co.il".split())
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three where the last two are a suffix of SUFFIXES."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def parted(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.col(url_col)
    return pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))


def matched(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (host, path) with rule and rule_verdict. The rules are a parameter of fixed size and become one expression:
    a map from rule host to its rules, asked for each suffix of the host."""
    by: dict[str, list] = {}
    for text, verdict in rules:
        host, _, path = text.partition("/")
        by.setdefault(host, []).append(F.struct(F.lit(text).alias("rule"), F.lit("/" + path).alias("at"), F.lit(verdict).alias("verdict")))
    if not by:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    table = F.create_map(*(x for host, own in by.items() for x in (F.lit(host), F.array(*own))))
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.flatten(F.transform(tails, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<struct<rule:string,at:string,verdict:string>>"))))
    fits = F.filter(own, lambda r: F.startswith(F.col("path"), r["at"]))
    best = F.get(F.array_sort(fits, lambda a, b: F.when(F.length(a["rule"]) != F.length(b["rule"]), F.length(b["rule"]) - F.length(a["rule"])).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0)), F.lit(0))
    return pages.withColumn("best", best).select("*", F.col("best")["rule"].alias("rule"), F.col("best")["verdict"].alias("rule_verdict")).drop("best")


def weight_of(groups: DataFrame, prior: Column) -> Column:
    """Prior weight of the groups (n, x) around prior, by moments: 1/rho - 1 for the over-dispersion rho."""
    var = F.sum(F.col("n") * prior * (1 - prior))
    rho = F.try_divide(F.sum((F.col("x") - F.col("n") * prior) * (F.col("x") - F.col("n") * prior)) - var, F.sum(F.col("n") * (F.col("n") - 1) * prior * (1 - prior)))
    return F.coalesce(F.when(rho <= 0, F.lit(MOST_WEIGHT)).otherwise(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), 1 / rho - 1))), F.lit(MOST_WEIGHT))


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, rate, low for every host of hosts and outcomes. outcomes: host, n, x (labelled pages, blocked ones) by host."""
    every = hosts.join(outcomes, "host", "full").na.fill(0, ["n", "x"]).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    rate = outcomes.agg(F.coalesce(F.try_divide(F.sum("x"), F.sum("n")), F.lit(0.0))).first()[0]
    every = materialize(every)
    own = materialize(every.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    top = shrunk(own.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("prior", F.lit(rate)))
    mid = shrunk(own.join(top.select("suffix", F.col("mean").alias("prior")), "suffix"))
    low = shrunk(every.join(mid.select("suffix", "domain", F.col("mean").alias("prior")), ["suffix", "domain"]))
    bound = F.col("mean") - 2 * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return low.select("host", F.col("mean").alias("rate"), bound.alias("low"))


def shrunk(groups: DataFrame) -> DataFrame:
    """Groups (n, x, prior), written once, with the posterior's mean and size."""
    groups = materialize(groups)
    w = groups.agg(weight_of(groups, F.col("prior"))).first()[0]
    return groups.withColumns({"mean": (F.col("x") + F.col("prior") * w) / (F.col("n") + w), "size": F.col("n") + w})


#: A broadcast of host reputations takes at most so many hosts (below 10 MB).
BROADCAST_HOSTS = 100_000


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = 0.5, outcomes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for every row. outcomes: (host, blocked boolean) rows of labelled pages; the rules' own verdicts where there are none."""
    judged = matched(parted(pages, id_col, url_col), rules)
    if outcomes is None:
        counted = judged.groupBy("host").agg(F.count("rule_verdict").alias("n"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("x"))
    else:
        counted = outcomes.groupBy("host").agg(F.count("blocked").alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("x"))
    counted = materialize(counted)
    hosts = counted.select("host") if outcomes is None else judged.select("host").distinct()
    rated = materialize(reputation(counted, hosts))
    known = rated.select("host", "rate", "low")
    if rated.count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)
    verdict = F.coalesce("rule_verdict", F.when(F.col("low") > limit, "block").otherwise("allow"))
    return judged.join(known, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rate")
