"""URL filters: host rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix (the last label, or the last two
where SECOND_LEVEL says so, as in co.uk; a domain has one label more).
Each level's rate is shrunk to its parent's: (bad + s * parent) / (n + s). The strength s of each level comes from the
data by moments of the beta-binomial: how much the groups' rates differ beyond what chance alone would do. A page is
blocked if its host's rate of bad pages passes LIMIT with a probability of at least SURE, that is if the posterior beta
distribution's lower quantile passes it. Where hosts differ no more than by chance none is blocked. All of it is counts
by host and joins by host; hot hosts are summed before any shuffle.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and gets the prior of the
empty host; a host that was never labelled gets its domain's posterior; repeated pages are judged alike.
"""

from pyspark.sql import Column, DataFrame, functions as F

from . import _spark

LIMIT, SURE = 0.25, 0.95
#: Bounds of the strength of a prior; steps of the integral of a beta density, over SPAN standard deviations each way.
WEAKEST, STRONGEST, STEPS, SPAN = 1.0, 1000.0, 400, 10.0
#: Labels that make a suffix with a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    parts = F.when((size > 1) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL), 2).otherwise(1)
    last = lambda n: F.when(size > n, F.concat_ws(".", F.slice(labels, size - n + 1, n))).otherwise(host)
    return last(parts + 1), last(parts)


def bad_for_sure(m: Column, size: Column) -> Column:
    """Whether a rate with the beta distribution of mean m and size (sum of its parameters) passes LIMIT with probability SURE.

    A mean of LIMIT or less never does. The density is summed at the middles of STEPS steps around the mean.
    """
    sd = F.sqrt(m * (1 - m) / (size + 1))
    low, high = F.greatest(F.lit(0.0), m - SPAN * sd), F.least(F.lit(1.0), m + SPAN * sd)
    x = lambda k: low + (high - low) * (k + 0.5) / STEPS
    log = lambda v: (m * size - 1) * F.log(v / m) + ((1 - m) * size - 1) * F.log((1 - v) / (1 - m))
    sums = F.aggregate(
        F.sequence(F.lit(0), F.lit(STEPS - 1)), F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("over")),
        lambda s, k: F.struct((s["all"] + F.exp(log(x(k)))).alias("all"), (s["over"] + F.when(x(k) > LIMIT, F.exp(log(x(k)))).otherwise(0.0)).alias("over")),
        lambda s: s["over"] >= SURE * s["all"],
    )
    return F.when((m > LIMIT) & (m < 1), sums).otherwise(m >= 1)


def _shrunk(groups: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """groups (with n, bad and the parent's key) with m, the posterior mean, and s, the strength of the prior; parents: key, parent."""
    g = groups.join(parents, key)
    rate = F.col("bad") / F.col("n")
    chance = F.sum(F.col("parent") * (1 - F.col("parent")))
    spread = (F.sum(F.col("n") * (rate - F.col("parent")) * (rate - F.col("parent"))) - chance) / F.sum("n")
    mean = F.sum(F.col("n") * F.col("parent") * (1 - F.col("parent"))) / F.sum("n")
    s = F.when(spread > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), mean / spread - 1))).otherwise(F.lit(STRONGEST))
    return g.crossJoin(F.broadcast(g.agg(F.coalesce(s, F.lit(STRONGEST)).alias("s")))).withColumn("m", (F.col("bad") + F.col("s") * F.col("parent")) / (F.col("n") + F.col("s")))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """outcomes: host, bad (0 or 1). Posterior means and sizes: by host (host, m, size), domain and suffix alike; and sure (bad_for_sure)."""
    domain, suffix = levels(F.col("host"))
    hosts = _spark.cut(outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    # One prior for all: a row, also where nothing is labelled.
    top = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("parent"))
    suffixes = hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(top)).withColumn("one", F.lit(1))
    suffixes = _spark.cut(_shrunk(suffixes.drop("parent"), top.withColumn("one", F.lit(1)), "one").select("suffix", "m", (F.col("n") + F.col("s")).alias("size")), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    domains = _spark.cut(_shrunk(domains, suffixes.select("suffix", F.col("m").alias("parent")), "suffix").select("domain", "m", (F.col("n") + F.col("s")).alias("size")), "domains")
    hosts = _shrunk(hosts.select("host", "domain", "n", "bad"), domains.select("domain", F.col("m").alias("parent")), "domain")
    hosts = hosts.select("host", "m", (F.col("n") + F.col("s")).alias("size"))
    return tuple(t.withColumn("sure", bad_for_sure(F.col("m"), F.col("size"))) for t in (hosts, domains, suffixes))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, bad_rate (posterior mean; 1/2 where nothing at all is known)."""
    host, path = split(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    by_host, by_domain, by_suffix = (_spark.small(_spark.cut(t, "posterior")) for t in reputation(outcomes))
    domain, suffix = levels(F.col("host"))
    rows = rows.select("*", domain.alias("domain"), suffix.alias("suffix"))
    for key, t in (("host", by_host), ("domain", by_domain), ("suffix", by_suffix)):
        rows = rows.join(t.select(key, F.col("m").alias(f"m_{key}"), F.col("sure").alias(f"sure_{key}")), key, "left")
    m, sure = F.coalesce("m_host", "m_domain", "m_suffix", F.lit(0.5)), F.coalesce("sure_host", "sure_domain", "sure_suffix", F.lit(False))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_method = F.when(sure, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), m.alias("bad_rate"))
