"""URL filter: rules on host and path, and logistic regression on hashed character n-grams.

Everything runs on DataFrame operations. The model is trained on a small labelled table by gradient
steps in the dual: the weights are a sum of the labelled rows, so a step needs only the products of
the rows with each other, and all steps are one aggregation over arrays. What comes back is one
number for each of the ``DIM`` weights. The weights are a literal array in the scoring plan, so
scoring is a map without join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import support

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path). A rule fits its host and all subdomains if the url's path begins with the rule's; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled URLs: unwanted ones by what they sell, wanted ones by what they are.
UNWANTED = (
    "casino-win", "casino-royal", "win-casino-slots", "poker-jackpot", "lottery-winner", "free-bets", "bets-online", "sport-bets-free", "cheap-pills", "pills-online",
    "cheap-meds", "viagra-store", "spam-farm", "link-farm", "seo-spam", "buy-followers", "adult-x", "adult-cams", "xxx-adult", "sex-videos", "porn-tube", "ads-track",
    "track-click-ads", "popup-ads", "win-prizes-free", "free-loans-cheap", "payday-loans", "crack-keygen", "warez-download", "replica-watches",
)
WANTED = (
    "university", "library", "museum", "gardening", "weather", "recipes", "history", "science-news", "city-council", "school", "theatre", "mountain", "journal", "research",
    "orchestra", "bakery", "reading-room", "mathematics", "archive", "travel-notes", "daily-news", "open-source", "hospital", "football-club", "music", "photography",
    "encyclopedia", "linguistics", "parliament", "railway",
)
PLACES = ("https://www.{}.com/", "http://{}.net/index.html", "https://{}.org/articles/{}", "http://blog.{}.info/{}/post", "https://{}.co.uk/item?id={}", "https://sites.host.io/{}/page/{}")

DIM = 4096
GRAMS = (3, 4)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def gram_buckets(host: Column, path: Column, dim: int = DIM) -> Column:
    """Hash buckets (from 1) of all character n-grams of host and path, which are told apart."""

    def of(text: Column, kind: str, n: int) -> Column:
        starts = F.when(F.length(text) + 2 >= n, F.sequence(F.lit(1), F.length(text) + 3 - n)).otherwise(F.array().cast("array<int>"))
        bucket = lambda chars, i: (F.pmod(F.xxhash64(F.lit(kind), F.concat(*[F.element_at(chars, i + k) for k in range(n)])), F.lit(dim)) + 1).cast("int")
        # The outer transform has one element: it binds the characters, which would else be split again for every n-gram.
        once = F.array(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""))
        return F.element_at(F.transform(once, lambda chars: F.transform(starts, lambda i: bucket(chars, i))), 1)

    return F.concat(*[of(text, kind, n) for text, kind in ((host, "host"), (path, "path")) for n in GRAMS])


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: (url, label), label 1 for unwanted."""
    rows = [(place.format(name, 10 + 7 * i + k), int(names is UNWANTED)) for names in (UNWANTED, WANTED) for i, name in enumerate(names) for k, place in enumerate(PLACES)]
    return spark.createDataFrame(rows, "url string, label int")


def margin(buckets: Column, weights: list[float]) -> Column:
    """The model's log odds: bias (the last weight) and the mean-scaled sum over the n-grams."""
    listed = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, i: acc + F.element_at(listed, i))
    return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + weights[-1]


def train(table: DataFrame, steps: int = 60, rate: float = 5.0, decay: float = 1e-3, dim: int = DIM, most: int = 1000) -> list[float]:
    """Logistic regression on a labelled table of (url, label) by full gradient steps; the bias comes last.

    At most ``most`` labelled rows are used, those with the smallest hashes. A row's features are the
    counts of its n-grams over the root of their number. The weights w are the sum of the rows x_s
    times some a_s, and the step w - rate * g, shrunk by ``decay``, is a step on the a_s.
    """
    host, path = split_url(F.coalesce("url", F.lit("")))
    chosen = table.filter("label IN (0, 1)").orderBy(F.xxhash64("url", "label"), "url", "label").limit(most)
    numbered = chosen.withColumn("r", F.row_number().over(Window.orderBy(F.xxhash64("url", "label"), "url", "label")))
    buckets = numbered.select("r", F.col("label").cast("double").alias("label"), gram_buckets(host, path, dim).alias("buckets")).cache()
    rows = buckets.count()
    if not rows:
        return [0.0] * (dim + 1)
    each = buckets.select("r", F.sqrt(F.size("buckets")).alias("root"), F.explode("buckets").alias("i"))
    features = each.groupBy("r", "i").agg((F.count("*") / F.first("root")).alias("v"))
    other = features.select(F.col("r").alias("s"), "i", F.col("v").alias("u"))
    products = features.join(other, "i").groupBy("r", "s").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
    known = products.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("s", "k"))).alias("k"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda s: F.coalesce(F.element_at("k", s), F.lit(0.0)))
    whole = buckets.select("r", "label").join(known, "r", "left").select("r", "label", dense.alias("k"))
    one = whole.groupBy().agg(F.sort_array(F.collect_list(F.struct("r", "label", "k"))).alias("x"))

    def step(model: Column, _: Column) -> Column:
        margin = lambda row: F.aggregate(F.zip_with(model["a"], row["k"], lambda a, k: a * k), F.lit(0.0), lambda p, q: p + q) + model["b"]
        off = F.transform("x", lambda row: 1.0 / (1.0 + F.exp(-margin(row))) - row["label"])
        total = lambda off: F.aggregate(off, F.lit(0.0), lambda p, q: p + q)
        moved = lambda off: F.struct(F.zip_with(model["a"], off, lambda a, o: (a - rate / rows * o) * (1 - decay)).alias("a"), (model["b"] - rate / rows * total(off)).alias("b"))
        return F.element_at(F.transform(F.array(off), moved), 1)  # the outer transform binds the errors, which are read twice

    start = F.struct(F.transform("x", lambda row: F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))
    model = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("m")).select(F.posexplode("m.a").alias("at", "a"), F.col("m.b").alias("b"))
    parts = features.join(model, F.col("r") == F.col("at") + 1).groupBy("i").agg(F.sum(F.col("a") * F.col("v")).alias("w"))
    weights = [0.0] * dim + [0.0]
    for i, w in parts.unionByName(model.filter("at = 0").select(F.lit(dim + 1).alias("i"), F.col("b").alias("w"))).collect():
        weights[i - 1] = w
    buckets.unpersist()
    return weights


def judge(df: DataFrame, url_column: str = "url", rules=RULES, weights: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``score`` (probability of an unwanted url) and ``verdict``.

    The verdict is the rule's where one fits, else ``block`` for scores from ``threshold`` on. A
    null url, an empty one and one without ``://`` have empty host and path, no rule, and the
    verdict of the model's bias. Urls of any length are read whole, repeated rows are judged alike,
    an empty table gives an empty table. Columns of the input with the names of the new ones are
    replaced; others are kept.
    """
    weights = train(labelled(df.sparkSession)) if weights is None else weights
    host, path = split_url(F.coalesce(url_column, F.lit("")))
    parts = df.withColumns({"host": host, "path": path})
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    score = 1.0 / (1.0 + F.exp(-margin(gram_buckets(F.col("host"), F.col("path"), len(weights) - 1), weights)))
    return parts.withColumns({"rule": rule, "score": score}).withColumn("verdict", F.coalesce(said, F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op10(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return judge(support.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
