"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt import session
from skyquilt.llm.queries import query, table

#: Rules (host and path prefix) are literals of the plan, so their number is bounded.
MAX_RULES = 10_000
#: Labelled URLs that the trees are fitted on, at most: those with the least hash.
SAMPLE = 50_000
TREES, DEPTH, SEED = 20, 4, 7
#: Suffixes of one, two and three host labels; each level's statistics have this many hashed buckets.
LEVELS, BUCKETS = 3, 4_096
PRIOR_WEIGHT = 10.0
NAMES = ["length", "depth", "digits", "entropy", "parameters", "host_labels", *[f"suffix_{k}" for k in range(1, LEVELS + 1)]]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null: its host is the url's or a parent domain, its path a prefix."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list] = {}
    for rule, verdict in rules.items():
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(
            F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    known = F.create_map(*[x for name, rows in by_host.items() for x in (F.lit(name), F.array(*rows))])
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(parents, lambda p: F.try_element_at(known, p)), lambda r: r.isNotNull())),
                    lambda r: F.startswith(path, r.path))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best.rule.alias("rule"), best.verdict.alias("verdict")))


def _suffix(name: Column, level: int) -> Column:
    return F.substring_index(name, ".", -level)


def _bucket(name: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), _suffix(name, level)), F.lit(BUCKETS)).cast("int")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the text of a url; a null url has those of an empty one."""
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    entropy = -F.aggregate(chars, F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))
    some = F.when(host != "", F.size(F.split(host, r"\."))).otherwise(0)
    return {
        "length": size.cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "digits": F.when(size > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / size).otherwise(0.0),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "parameters": F.regexp_count(F.regexp_extract(text, r"\?([^#]*)", 1), F.lit("[^&=]+=")).cast("double"),
        "host_labels": some.cast("double"),
    }


def _features(rows: DataFrame) -> DataFrame:
    """Adds the features without suffix statistics, and the buckets, to rows with url, host and path."""
    plain = lexical(F.col("url"), F.col("host"), F.col("path"))
    return rows.withColumns(plain | {f"bucket_{k}": _bucket(F.col("host"), k) for k in range(1, LEVELS + 1)})


class Filter:
    """Fitted trees and suffix statistics; both are bounded in size."""

    def __init__(self, model: GBTClassificationModel | None, suffixes: DataFrame, share: float):
        self.model, self.suffixes, self.share = model, suffixes, share

    def with_suffixes(self, rows: DataFrame, own: Column | None = None) -> DataFrame:
        """Adds the smoothed share of blocked URLs of each suffix; without the row's own label ``own`` in training."""
        for k in range(1, LEVELS + 1):
            stats = self.suffixes.filter(F.col("level") == k).select(F.col("bucket").alias(f"bucket_{k}"), "n", "blocked")
            rows = rows.join(F.broadcast(stats), f"bucket_{k}", "left")  # BUCKETS rows at most
            n, blocked = F.coalesce("n", F.lit(0.0)), F.coalesce("blocked", F.lit(0.0))
            if own is not None:
                n, blocked = n - 1, blocked - own
            rows = rows.withColumn(f"suffix_{k}", (blocked + PRIOR_WEIGHT * self.share) / (n + PRIOR_WEIGHT)).drop("n", "blocked")
        return rows

    def blocked(self, rows: DataFrame) -> DataFrame:
        """Adds ``p_block``, the trees' probability that a url should be blocked."""
        if self.model is None:
            return rows.withColumn("p_block", F.lit(self.share))
        packed = VectorAssembler(inputCols=NAMES, outputCol="features").transform(self.with_suffixes(_features(rows)))
        return self.model.transform(packed).withColumn("p_block", vector_to_array("probability")[1])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Filter:
    """Fit on ``labelled(url, blocked)`` (0/1; rows with a null label are left out).

    Suffix statistics come from all labelled URLs, the trees from ``sample`` of
    them at most. Without labels, or with one class only, there are no trees and
    every url gets the share of blocked ones (0 without labels).
    """
    spark = labelled.sparkSession
    rows = labelled.dropna(subset=["blocked"]).select("url", F.col("blocked").cast("double").alias("blocked_label"))
    rows = session.cut(_features(rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})), "labelled")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked_label").alias("bad")).first()
    share = (facts.bad or 0.0) / facts.n if facts.n else 0.0
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"bucket_{k}").alias("bucket")) for k in range(1, LEVELS + 1)]))
    stats = rows.select(level.alias("s"), "blocked_label").groupBy("s.level", "s.bucket").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("blocked_label").alias("blocked"))
    made = Filter(None, session.cut(stats, "suffixes"), share)
    if not 0 < share < 1:
        return made
    chosen = rows.orderBy(F.xxhash64("url", "blocked_label"), "url").limit(sample)
    packed = VectorAssembler(inputCols=NAMES, outputCol="features").transform(made.with_suffixes(chosen, F.col("blocked_label")))
    train_rows = session.cut(packed.select("features", F.col("blocked_label").alias("label")), "training").coalesce(spark.sparkContext.defaultParallelism)
    # the cut keeps no metadata of the vectors, which the trees do not need
    made.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.2).fit(train_rows)
    return made


def judge(pages: DataFrame, rules: dict[str, str], made: Filter, threshold: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, p_block)`` for each row.

    The verdict (allow or block) is the rule's if one fits, else the trees'. A
    null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by the features of its text. Repeated rows are judged alike.
    No rows: no rows.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = made.blocked(rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)))
    verdict = F.coalesce("best.verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "p_block")


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def labelled_pages(pages: DataFrame, labels: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(url, blocked)``: the verdict of a fitting rule, else the label of the page's id (poor or toxic is blocked)."""
    bad = labels.dropna(subset=["doc_id"]).groupBy(F.col("doc_id").alias("of")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1.0).otherwise(0.0)).alias("bad"))
    rows = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("of"), "left")
    rule = best_rule(host(F.col("url")), path(F.col("url")), rules)
    return rows.select("url", F.when(rule.isNotNull(), F.when(rule.verdict == "block", 1.0).otherwise(0.0)).otherwise(F.col("bad")).alias("blocked"))


@query("op1_url_trees")
def op1_url_trees(spark, sf):
    pages = table(spark, sf, "pages")
    return judge(pages, RULES, train(labelled_pages(pages, table(spark, sf, "labels"), RULES)))
