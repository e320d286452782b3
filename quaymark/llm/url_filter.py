"""URL filters: allow and block rules, then gradient-boosted trees on lexical features.

A rule such as ``org/`` or ``example.org/en/1`` fits its host and all subdomains if the path of the url
starts with its own; the longest rule that fits decides. The urls that a rule decides are the labelled
ones: the trees are fitted on a bounded sample of them (``TRAIN_ROWS``, the least by a hash of the url) and
judge all others. Features are length, depth, digit ratio, entropy of the characters, numbers of
parameters and marks, and statistics of the url's suffix (the last two labels of the host) and of its section (the
last label with the first part of the path) that are counted over all urls. For a labelled url the share of blocked ones is counted without its own fold of ``FOLDS``, so no label stands in
its own features; ``held_out`` gives the accuracy on a fold that the fit has not seen. DataFrame functions and Spark's own trees only.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it. Repeated rows each
get a row. An empty table gives no rows. If the labelled urls are all of one kind, so is the verdict.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.sources.shared import stored

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 5
FOLDS = 5
#: Weight of the prior in the share of blocked urls of a suffix.
PRIOR = 5.0

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_marks", "f_host", "f_labels", "f_suffix_log", "f_suffix_blocked", "f_section_log", "f_section_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), empty), F.coalesce(path, empty)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``(length, rule, verdict)``, else null."""
    fitting = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        entry = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(fits, entry))
    return F.array_max(F.array_compact(F.array(*fitting)))


def _entropy(url: Column) -> Column:
    """Bits per character."""
    count = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)
    return F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda sum_, c: sum_ - count(c) * F.log2(count(c)))


def _lexical(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``, with host, path, rule and the features that need no other row."""
    host, path = host_and_path(F.col("url"))
    url = F.coalesce("url", F.lit(""))
    kept = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    chars = F.length("url")
    share = lambda pattern: F.regexp_count("url", F.lit(pattern)) / F.greatest(chars, F.lit(1))
    return kept.withColumn("best", best_rule(F.col("host"), F.col("path"))).select(
        "page_id", "url", "host", "path",
        F.col("best.rule").alias("rule"),
        F.col("best.verdict").alias("ruled"),
        F.substring_index("host", ".", -2).alias("suffix"),
        F.concat_ws("/", F.substring_index("host", ".", -1), F.split_part("path", F.lit("/"), F.lit(2))).alias("section"),
        F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold"),
        chars.cast("double").alias("f_length"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("f_depth"),
        share("[0-9]").alias("f_digits"),
        F.when(chars > 0, _entropy(F.col("url"))).otherwise(0.0).alias("f_entropy"),
        F.regexp_count("url", F.lit("[?&][^&#=]*=")).cast("double").alias("f_params"),
        F.regexp_count("url", F.lit("[-_%@~#]")).cast("double").alias("f_marks"),
        F.length("host").cast("double").alias("f_host"),
        F.size(F.split("host", "\\.")).cast("double").alias("f_labels"),
    )


def _with_shares(urls: DataFrame, key: str) -> DataFrame:
    """``urls`` with the log of the number of urls of their ``key``, and the smoothed share of blocked ones among the labelled."""
    parts = urls.groupBy(key, "fold").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    parts = stored(parts, "url-shares")
    wholes = parts.groupBy(key).agg(*[F.sum(x).alias(f"all_{x}") for x in ("n", "labelled", "blocked")])
    prior = parts.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("prior"))
    share = lambda blocked, labelled: (blocked + PRIOR * F.col("prior")) / (labelled + PRIOR)
    # the other side is one row
    shares = parts.join(wholes, key).crossJoin(F.broadcast(prior)).select(
        key, "fold",
        F.log1p("all_n").alias(f"f_{key}_log"),
        share(F.col("all_blocked"), F.col("all_labelled")).alias("all_share"),
        share(F.col("all_blocked") - F.col("blocked"), F.col("all_labelled") - F.col("labelled")).alias("other_share"),
    )
    blocked = F.when(F.col("ruled").isNull(), F.col("all_share")).otherwise(F.col("other_share"))
    return urls.join(stored(shares, "url-shares"), [key, "fold"]).withColumn(f"f_{key}_blocked", blocked).drop("all_share", "other_share")


def fit(urls: DataFrame) -> PipelineModel | None:
    """Trees fitted on the bounded sample of labelled urls; none unless both kinds occur."""
    labelled = urls.where("ruled is not null").orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
    sample = stored(labelled.select((F.col("ruled") == "block").cast("double").alias("label"), *FEATURES), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(sample)


def _scored(lexical: DataFrame) -> DataFrame:
    """``lexical`` with the trees' ``score`` and the verdict of the rule, else of the trees."""
    urls = _with_shares(_with_shares(lexical, "suffix"), "section")
    model = fit(urls)
    if model is None:
        only = lexical.where("ruled is not null").select("ruled").first()
        scored = urls.withColumn("score", F.lit(1.0 if only and only[0] == "block" else 0.0))
    else:
        scored = model.transform(urls).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow")))


def judged(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the trees' ``score`` of each row of ``pages``."""
    return _scored(stored(_lexical(pages), "url-features")).select("page_id", "host", "path", "rule", "verdict", "score")


def held_out(pages: DataFrame) -> float:
    """The share of the labelled urls of one fold that trees get right which were fitted without the fold."""
    lexical = _lexical(pages).withColumn("truth", F.col("ruled")).withColumn("ruled", F.when(F.col("fold") != 0, F.col("ruled")))
    found = _scored(stored(lexical, "url-features")).where("fold = 0 and truth is not null")
    return found.agg(F.avg((F.col("verdict") == F.col("truth")).cast("double"))).first()[0]


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2 over all pages."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
