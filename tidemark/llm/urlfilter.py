"""URL filters: rules, then a logistic regression on hashed character n-grams of host and path; DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick

#: Fixed values: (verdict, rule). A rule's host ends at its first slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: n-grams of a host or path, hashed into so many buckets; steps and rate of gradient descent, and the weight of the penalty.
GRAMS, BUCKETS = (3, 4), 8192
STEPS, RATE, PENALTY = 400, 0.5, 1e-3

_GOOD = "news library museum recipes weather garden school history science music travel forum docs blog wiki health".split()
_BAD = "ads adserver ad-track tracker tracking pixel banner clicks popup popads casino poker bets betting pills adult xxx porn spam spammer malware phishing warez beacon sponsor promo-deals".split()
_PATHS = ("/en/120", "/de/57/", "/fr/3404?x", "/es/21.html", "/", "/a/2044.html", "")
_PREFIXES = ("", "www.", "m.", "blog.")


def labelled_urls() -> list[tuple[str, int]]:
    """The small table that the model learns from: (url, 1 to block or 0 to allow), made by rule from lists of names.

    Both kinds have the same zones, prefixes and paths; names made of syllables stand for the many hosts that mean nothing.
    """
    plain = [a + b for a in ("tor", "len", "mash", "rin", "dov", "ket", "sul", "bra", "the", "on", "thi", "er") for b in ("ing", "edo", "tion", "ble", "th", "an")]
    out = []
    for label, names, copies in ((0, [*_GOOD, *plain], 2), (1, _BAD, 4)):
        for k, name in enumerate(names):
            for j in range(copies):
                prefix, zone = _PREFIXES[(k + j * (4 // copies)) % 4], ("example.com", "example.net", "example.org")[(k + j) % 3]
                out.append((f"https://{prefix}{name}.{zone}{_PATHS[(k + 3 * j) % len(_PATHS)]}", label))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for null and for what has no `://`."""
    start = F.locate("://", url)
    rest = F.when(start > 0, url.substr(start + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), letters, letters.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def gram_features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of the n-grams of a host and a path; an n-gram of the host never counts as one of the path."""
    def grams(kind: str, text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), text.substr(i, F.lit(n))), F.lit(buckets)).cast("int"))

    named = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$"))))
    parts = [grams(kind, text, n) for kind, text in named for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def margin(features: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    return F.aggregate(features, F.element_at(weights, F.lit(buckets + 1)), lambda a, f: a + F.element_at(weights, f + 1))


def train(spark: SparkSession, urls: Sequence[tuple[str, int]] | None = None, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> list[float]:
    """buckets + 1 weights, the last for the constant, by gradient descent over the whole labelled table.

    The table becomes one row of arrays (it is small by contract), with the buckets that occur in it numbered from 0, and the
    descent an aggregation over 2 * steps turns: one turn finds the examples' errors, the next adds them up by bucket.
    """
    urls = labelled_urls() if urls is None else list(urls)
    rows = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("n"), F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for k, (u, y) in enumerate(urls)))))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("n", "label", F.explode(F.concat(gram_features(host, path, buckets), F.array(F.lit(buckets)))).alias("bucket"))
    used = rows.groupBy("bucket").agg(F.sort_array(F.collect_list("n")).alias("of"))
    used = used.agg(F.sort_array(F.collect_list(F.struct("bucket", "of"))).alias("x")).select(F.posexplode("x").alias("j", "x")).select("j", "x.bucket", "x.of")
    examples = rows.join(used.select("j", "bucket"), "bucket").groupBy("n", "label").agg(F.collect_list(F.col("j") + 1).alias("of"))
    examples = examples.agg(F.sort_array(F.collect_list(F.struct("n", "label", "of"))).alias("examples"))
    places = used.agg(F.sort_array(F.collect_list(F.struct("j", "bucket", "of"))).alias("x")).select(F.col("x.bucket").alias("buckets"), F.col("x.of").alias("places"))
    both = examples.unionByName(places, allowMissingColumns=True)  # two rows become one, without a join
    one = both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("examples", "buckets", "places")))

    def turn(state: Column, t: Column) -> Column:
        score = lambda of: F.aggregate(of, F.lit(0.0), lambda a, j: a + F.element_at(state["w"], j))
        errors = F.transform("examples", lambda e: e["label"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-score(e["of"]))))
        moved = F.transform("places", lambda of, j: F.element_at(state["w"], j + 1) * (1 - rate * penalty) + F.lit(rate / len(urls)) * F.aggregate(of, F.lit(0.0), lambda a, n: a + F.element_at(state["e"], n + 1)))
        return F.when(F.pmod(t, F.lit(2)) == 0, F.struct(state["w"].alias("w"), errors.alias("e"))).otherwise(F.struct(moved.alias("w"), state["e"].alias("e")))

    start = F.struct(F.transform("buckets", lambda _: F.lit(0.0)).alias("w"), F.array().cast("array<double>").alias("e"))
    found = one.select("buckets", F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps - 1)), start, turn)["w"].alias("w")).first()
    weights = [0.0] * (buckets + 1)
    for bucket, weight in zip(found["buckets"], found["w"], strict=True):
        weights[bucket] = weight
    return weights


_FITTED: dict[tuple[str, int], list[float]] = {}


def fitted(spark: SparkSession, buckets: int = BUCKETS) -> list[float]:
    """The weights of the labelled urls, fitted once for each Spark application."""
    key = (spark.sparkContext.applicationId, buckets)
    if key not in _FITTED:
        _FITTED[key] = train(spark, buckets=buckets)
    return _FITTED[key]


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The verdict (value 0) or the rule (1) of the longest rule that fits; null if none does."""
    out = []
    for rule in sorted(rules, key=lambda r: len(r[1]), reverse=True):
        rule_host, slash, rest = rule[1].partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out.append(F.when(fits, F.lit(rule[value])))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, weights: Sequence[float] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict, probability.

    The longest rule that fits decides, else the model: block from a probability of 0.5 on. A null url and one without `://`
    have an empty host and path and get the model's verdict for those. Repeated rows give equal rows; an empty table gives none; other
    columns are ignored. A long url is taken whole. The weights (one for each bucket) are a constant of the plan.
    """
    pages = pick(pages, page_id=id_col, url=url_col)
    weights = fitted(pages.sparkSession, buckets) if weights is None else list(weights)
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = F.lit([float(w) for w in weights])
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(gram_features(F.col("host"), F.col("path"), buckets), known, buckets)))
    host, path = F.col("host"), F.col("path")
    scored = split.select("page_id", "host", "path", rule_column(host, path, rules, 1).alias("rule"), rule_column(host, path, rules, 0).alias("ruled"), probability.alias("probability"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability")
