"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Pages that a rule decides are the labelled outcomes (allowed: good, blocked: bad). Their
rates are shrunk through beta-binomial priors: the suffix's rate towards that of all pages,
the registered domain's towards its suffix, the host's towards its domain. A level's prior
weight comes from the spread of its groups' rates by the method of moments. A page without a
rule is allowed if the lower bound of its host's posterior rate reaches the wanted rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: public suffixes of two labels, by default; every other suffix is the last label
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
WANTED, Z = 0.3, 1.0
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def parts(url: str) -> tuple[str, str]:
    """SQL for (host, path) of a url: both empty for null or without ``://``."""
    u = f"coalesce({url}, '')"
    rest = f"if(instr({u}, '://') > 0, substring({u}, instr({u}, '://') + 3), '')"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return host, f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _best_rule(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _weight(groups: DataFrame, parent: DataFrame, on: str | None) -> float:
    """Prior weight of a level: from the between-group variance about the parents' rates."""
    g = groups.join(parent, on) if on else groups.crossJoin(F.broadcast(parent))
    m = F.col("parent_mean")
    row = g.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("good") / F.col("n") - m) ** 2).alias("s"), F.sum(m * (1 - m)).alias("v"), F.count("*").alias("k"), F.sum(F.col("n") * m * (1 - m)).alias("w")
    ).first()
    if not row["k"] or row["k"] < 2 or not row["w"]:
        return MOST_WEIGHT
    # E[sum n (p - m)^2] = sum m(1-m) (1 + (n - 1) rho), rho = 1 / (weight + 1)
    extra = row["w"] - row["v"]
    rho = (row["s"] - row["v"]) / extra if extra > 0 else 0.0
    return MOST_WEIGHT if rho <= 0 else min(max(1 / min(rho, 1.0) - 1, LEAST_WEIGHT), MOST_WEIGHT)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, wanted: float = WANTED, z: float = Z, double_suffixes: tuple[str, ...] = DOUBLE_SUFFIXES) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, and the host's posterior rate and bound.

    A null url, or one without ``://``, has empty host and path and is judged by the rate of
    all pages. Without any labelled outcome every rate is 1/2. For its reputation a host goes
    without user and port, and an address is its own domain and suffix. Repeated pages count
    each. Extra columns are ignored; an empty table gives an empty result. Hosts are counted
    once and written out; hot hosts meet partial aggregations and joins that Spark can split.
    """
    host, path = parts(f"`{url_col}`")
    df = pages.select(F.col(id_col).alias("page_id"), F.expr(host).alias("host"), F.expr(path).alias("path"))
    rule, verdict = _best_rule(rules)
    df = df.withColumns({"rule": rule, "ruled": verdict})
    outcomes = df.groupBy("host").agg(F.count("ruled").cast("double").alias("n"), F.count(F.when(F.col("ruled") == "allow", 1)).cast("double").alias("good"))
    outcomes = outcomes.withColumn("name", F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""))
    tail, address = F.expr("substring_index(name, '.', -2)"), F.col("name").rlike(r"^([0-9.]+|\[.*)$")
    suffix = F.when(address, F.col("name")).when(tail.isin(*double_suffixes), tail).otherwise(F.expr("substring_index(name, '.', -1)"))
    outcomes = outcomes.withColumn("suffix", suffix).withColumn("domain", F.expr("substring_index(name, '.', -1 - size(split(suffix, '[.]')))"))
    outcomes = materialize(outcomes, "hosts")
    domains = outcomes.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    root = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("parent_mean"))

    def shrink(level: DataFrame, parent: DataFrame, on: str | None, key: str) -> tuple[DataFrame, float]:
        k = _weight(level.filter("n > 0"), parent, on)
        joined = level.join(parent, on) if on else level.crossJoin(F.broadcast(parent))
        return joined.withColumn("mean", (F.col("good") + k * F.col("parent_mean")) / (F.col("n") + k)), k

    s, _ = shrink(suffixes, root, None, "suffix")
    d, _ = shrink(domains, s.select("suffix", F.col("mean").alias("parent_mean")), "suffix", "domain")
    h, k = shrink(outcomes, d.select("domain", F.col("mean").alias("parent_mean")), "domain", "host")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    h = h.select("host", F.round("mean", 9).alias("rate"), F.round(F.col("mean") - z * sd, 9).alias("bound"))
    out = df.join(h, "host")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") >= wanted, "allow").otherwise("block")).alias("verdict"), "rate", "bound")
