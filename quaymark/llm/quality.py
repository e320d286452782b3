"""Quality rules: base rules on counts, then robust multivariate outliers. DataFrame functions only.

For each language and source, a minimum-covariance-determinant estimate of location and scatter is made of
five transformed statistics of the texts: log of the mean word length, and square roots of the shares of
upper-case letters, of ASCII marks, of the symbols ``#*$%&|<>`` and of duplicate lines. Short texts scatter more, so
each statistic is drawn towards its median by the root of ``n / (n + k)``, n being the words of the text.

Three orders by deviations from the medians start the estimate (sum of squares, largest, sum of bounded squares). Concentration
steps then take mean and covariance over the three quarters of the rows that lie closest under the last estimate, until
the determinant falls no more; of the three, the least determinant counts. The cube root of a squared Mahalanobis
distance is nearly normal. Its centre and spread are taken from the median and the upper quartile of the stratum, weighed
with those of the language as if ``PRIOR`` rows came from there, and are never less than those of chi-square. A
document is rejected beyond ``Z`` spreads, a false-positive rate of 1 in 10,000 for normal roots. No stratum is too small for the
rule: least standard deviations keep a small one from rejecting what is near.

Statistics are kept as whole multiples of 1/``GRID``, so sums are exact and the verdicts do not hang on the
order in which rows are added. All aggregation is per stratum with partial sums and counts before the shuffle, so a
source with a third of all rows costs no task more than others; quantiles come from counts of grid values.

Nulls: a null text has no words and fails the base rules; a null language or source is a value like any
other. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.sources.shared import stored

WINDOW = 8
GRID = 4096
SHARE = 0.75
#: Concentration steps at most; they end as a rule after three to six.
STEPS = 30
#: Rejected beyond so many spreads: the normal quantile of 0.9999.
Z = 3.72
#: Rows that the language's centre and spread weigh in those of a stratum.
PRIOR = 30
#: Centre and spread of the cube roots of chi-square with five degrees of freedom.
CHI_CENTRE, CHI_SPREAD = 1.632, 0.365
#: The upper quartile of the standard normal distribution.
QUARTILE = 0.6745
#: Least standard deviation of each statistic, so that a stratum with hardly any spread rejects nothing near.
FLOORS = (0.02, 0.01, 0.01, 0.02, 0.1)
#: Words at which a statistic is drawn half of the way (in variance) to its median; lines are fewer than words.
DRAWN = (200, 200, 200, 200, 1000)
STATS = tuple(f"s{i}" for i in range(len(FLOORS)))

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Positions whose window occurs elsewhere in the text, then the number of words that such windows cover.
_REPEATED = f"""
CASE WHEN size(w) < {WINDOW} OR size(array_distinct(h)) = size(h) THEN 0L ELSE
  transform(array(
    transform(
      array(sort_array(transform(sequence(0, size(w) - {WINDOW}),
            i -> struct(array_join(slice(w, i + 1, {WINDOW}), ' ') AS x, i AS i)))),
      s -> sort_array(transform(
             filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) OR coalesce(get(s, k + 1).x = e.x, false)),
             e -> e.i)))[0]),
    p -> aggregate(p, struct(0L AS n, -{WINDOW} AS last),
           (a, q) -> struct(a.n + least({WINDOW}, q - a.last) AS n, q AS last),
           a -> a.n))[0]
END
"""


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    """Occurrences of ASCII characters."""
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


def measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The base counts and those of the statistics, with the columns ``carried`` of ``docs`` in a struct ``doc``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*carried).alias("doc"), F.col("lang"), F.col("source"), t.alias("t"))
    inner = F.trim("t", F.lit(BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))
    hashes = F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), i -> xxhash64(slice(w, i + 1, {WINDOW})))")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    counted = rows.withColumn("w", words).withColumn("h", hashes).withColumn("l", lines)
    return counted.select(
        "doc", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        _count(F.col("t"), UPPER).alias("n_upper"),
        _count(F.col("t"), MARKS).alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _statistics() -> list[Column]:
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    raw = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_upper", "word_chars"),
        share("n_marks", "word_chars"),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
    ]
    return [F.floor(x * GRID + 0.5).cast("long").alias(s) for x, s in zip(raw, STATS)]


def _quantiles(values: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Of each group, the least ``value`` that has a share of all values at or below it; from counts of values."""
    times = F.sum("times") if "times" in values.columns else F.count("*")
    counts = values.groupBy(*keys, "value").agg(times.alias("times"))
    whole = Window.partitionBy(*keys)
    # no more rows in a group than grid values
    placed = counts.select(*keys, "value", F.sum("times").over(whole.orderBy("value")).alias("upto"), F.sum("times").over(whole).alias("all"))
    return placed.groupBy(*keys).agg(F.max("all").alias("members"), *[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("value"))).alias(name) for name, share in shares.items()])


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """``(stratum, name_0, ...)``: the medians of some whole numbers."""
    each = rows.select("stratum", F.posexplode(F.array(*values)).alias("stat", "value"))
    found = _quantiles(each, ["stratum", "stat"], {"middle": 0.5})
    return found.groupBy("stratum").agg(*[F.max(F.when(F.col("stat") == i, F.col("middle"))).alias(f"{name}_{i}") for i in range(len(values))])


def _drawn() -> dict[str, Column]:
    """The statistics drawn towards their medians ``q_*``."""
    share = lambda k: F.sqrt(F.col("n_words") / (F.col("n_words") + k))
    return {s: F.floor(F.col(f"q_{i}") + (F.col(s) - F.col(f"q_{i}")) * share(k) + 0.5).cast("long") for i, (s, k) in enumerate(zip(STATS, DRAWN))}


def _coarse(d2: Column) -> Column:
    """Distances on a grid of steps of under two in a hundred, so that quantiles need few counts."""
    return F.floor(64 * F.log1p(d2))


def _starts(sample: DataFrame, scales: DataFrame) -> DataFrame:
    """Each row three times, with its distance under each start."""
    z2 = [F.pow((F.col(s) - F.col(f"q_{i}")) / GRID, F.lit(2)) / (F.pow(1.4826 * F.col(f"d_{i}") / GRID, F.lit(2)) + FLOORS[i] ** 2) for i, s in enumerate(STATS)]
    orders = [sum(z2, F.lit(0.0)), F.greatest(*z2), sum((F.least(z, F.lit(9.0)) for z in z2), F.lit(0.0))]
    return sample.join(scales, "stratum").select("stratum", *STATS, F.posexplode(F.array(*orders)).alias("start", "d2"))


def _concentrated(near: DataFrame) -> DataFrame:
    """Of each stratum and start, mean ``m_*``, lower triangle ``l_*_*`` of the covariance and log ``determinant`` over the closest rows."""
    k = range(len(STATS))
    totals = [f"t_{i}" for i in k] + [f"t_{i}_{j}" for i in k for j in range(i + 1)]
    # a cell holds some hundred billion rows of usual words before a long overflows, which raises an error
    cells = near.groupBy("stratum", "start", _coarse(F.col("d2")).alias("value")).agg(
        F.count("*").alias("times"),
        *[F.sum(STATS[i]).alias(f"t_{i}") for i in k],
        *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"t_{i}_{j}") for i in k for j in range(i + 1)],
    )
    whole = Window.partitionBy("stratum", "start")
    before = F.sum("times").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    # no more rows in a group than grid values; the last one inside is the least that reaches the share
    inner = cells.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum("times").over(whole).alias("all")).where(F.col("before") < SHARE * F.col("all"))
    exact = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).cast("double").alias(x)
    # written before they are worked up: many columns, which the driver would plan anew with each stage of the steps before
    sums = stored(inner.groupBy("stratum", "start").agg(F.sum("times").alias("n"), *[exact(x) for x in totals]), "quality-sums")
    mean = [F.col(f"t_{i}") / F.col("n") / GRID for i in k]
    found = sums.select(
        "stratum", "start",
        *[mean[i].alias(f"m_{i}") for i in k],
        *[(F.col(f"t_{i}_{j}") / F.col("n") / GRID / GRID - mean[i] * mean[j] + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in k for j in range(i + 1)],
    )
    # one projection: each column may use those before it
    lower = []
    for j in k:
        pivot = F.col(f"c_{j}_{j}") - sum((F.pow(f"l_{j}_{q}", F.lit(2)) for q in range(j)), F.lit(0.0))
        lower.append(F.sqrt(F.greatest(pivot, F.lit(1e-9))).alias(f"l_{j}_{j}"))
        for i in range(j + 1, len(STATS)):
            rest = F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{q}") * F.col(f"l_{j}_{q}") for q in range(j)), F.lit(0.0))
            lower.append((rest / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
    found = found.select("*", *lower)
    determinant = sum((2 * F.log(f"l_{i}_{i}") for i in k), F.lit(0.0)).alias("determinant")
    return found.select("stratum", "start", determinant, *[f"m_{i}" for i in k], *[f"l_{i}_{j}" for i in k for j in range(i + 1)])


def _distance(joined: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` and ``d2``, the squared Mahalanobis distance of rows that have their stratum's estimate."""
    scaled = []
    for i, s in enumerate(STATS):
        rest = F.col(s) / GRID - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{j}") * F.col(f"y_{j}") for j in range(i)), F.lit(0.0))
        scaled.append((rest / F.col(f"l_{i}_{i}")).alias(f"y_{i}"))
    joined = joined.select("*", *scaled)
    return joined.select(*carried, sum((F.pow(f"y_{i}", F.lit(2)) for i in range(len(STATS))), F.lit(0.0)).alias("d2"))


def _least_determinants(sample: DataFrame, scales: DataFrame) -> DataFrame:
    """The estimate of each stratum: concentrated from every start until no determinant falls, the least one chosen."""
    best = stored(_concentrated(_starts(sample, scales)).withColumn("fell", F.lit(True)), "quality-estimate")
    for _ in range(STEPS):
        # what fell no more gives the same estimate again and is left alone
        near = _distance(sample.join(best.where("fell"), "stratum"), ["stratum", "start", *STATS])
        new = _concentrated(near).select("stratum", "start", F.struct("*").alias("new"))
        both = best.select("stratum", "start", F.struct(*[c for c in best.columns if c != "fell"]).alias("old")).join(new, ["stratum", "start"], "left")
        fell = F.coalesce(F.col("new.determinant") < F.col("old.determinant") - 1e-9, F.lit(False))
        best = stored(both.select(F.when(fell, F.col("new")).otherwise(F.col("old")).alias("e"), fell.alias("fell")).select("e.*", "fell"), "quality-estimate")
        if best.where("fell").isEmpty():
            break
    chosen = best.drop("fell").groupBy("stratum").agg(F.min(F.struct("determinant", "start", F.struct("*").alias("e"))).alias("row"))
    return chosen.select("row.e.*").drop("start", "determinant")


def _limits(distances: DataFrame) -> DataFrame:
    """``(stratum, centre, spread)`` of the cube roots of the distances."""
    roots = stored(distances.select("stratum", "pool", F.floor(256 * F.cbrt("d2")).alias("value")).groupBy("stratum", "pool", "value").agg(F.count("*").alias("times")), "quality-roots")
    own, pooled = (_quantiles(roots, [key], {"middle": 0.5, "upper": 0.75}) for key in ("stratum", "pool"))
    pooled = pooled.select("pool", F.col("middle").alias("pool_middle"), F.col("upper").alias("pool_upper"))
    of = roots.select("stratum", "pool").distinct()
    weigh = lambda x: (F.col("members") * F.col(x) + PRIOR * F.col(f"pool_{x}")) / (F.col("members") + PRIOR) / 256
    centre, spread = weigh("middle"), (weigh("upper") - weigh("middle")) / QUARTILE
    return own.join(of, "stratum").join(pooled, "pool").select(
        "stratum", F.greatest(centre, F.lit(CHI_CENTRE)).alias("centre"), F.greatest(spread, F.lit(CHI_SPREAD)).alias("spread")
    )


def judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``doc`` (the columns ``carried``), the base counts, ``base_failed``, ``distance`` (in spreads) and ``kept`` of each row."""
    counts = measured(docs, carried)
    named = {"stratum": F.xxhash64(F.to_json(F.struct("lang", "source"))), "pool": F.xxhash64(F.to_json(F.struct("lang")))}
    rows = counts.withColumn("base_failed", base_failed()).withColumns(dict(zip(STATS, _statistics()))).withColumns(named)
    return _verdicts(stored(rows, "quality-counts"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    return judged(docs, docs.columns).where("kept").select("doc.*")


def _verdicts(rows: DataFrame) -> DataFrame:
    # tables with a row for each stratum are written, so that the planner knows how small they are before it joins them
    fit = rows.where("not base_failed").select("stratum", "pool", "n_words", *STATS)
    medians = stored(_medians(fit, [F.col(s) for s in STATS], "q"), "quality-medians")
    sample = stored(fit.join(medians, "stratum").withColumns(_drawn()).select("stratum", "pool", *STATS), "quality-sample")
    deviations = _medians(sample.join(medians, "stratum"), [F.abs(F.col(s) - F.col(f"q_{i}")) for i, s in enumerate(STATS)], "d")
    scales = stored(medians.join(deviations, "stratum"), "quality-scales")
    best = stored(_least_determinants(sample, scales), "quality-estimate")
    limits = stored(_limits(_distance(sample.join(best, "stratum"), ["stratum", "pool"])), "quality-limits")
    strata = stored(medians.join(best, "stratum").join(limits, "stratum"), "quality-strata")
    # rows that failed the base rules may have no stratum
    placed = rows.join(strata, "stratum", "left").withColumns(_drawn())
    final = _distance(placed, [*(c for c in rows.columns if c not in ("stratum", "pool", *STATS)), "centre", "spread"])
    distance = (F.cbrt("d2") - F.col("centre")) / F.col("spread")
    return (
        final.withColumn("distance", distance)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(distance <= Z, F.lit(True)))
        .drop("d2", "centre", "spread")
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10: the base counts, the base verdict and whether each document is kept."""
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
