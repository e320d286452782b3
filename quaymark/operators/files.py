"""What takes several files, fields or places together: orphans, dates, towns, labels, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.rules import date_bucket, stem
from quaymark.operators.similarity import haversine
from quaymark.sources.shared import stored

SIDECARS = (".xmp", ".txt", ".tracks.json")
AMBIGUOUS_KM = 100.0
DATES = ("d_actual", "d_original", "d_capture", "d_digitized", "d_modified")


def orphan_sidecars(files: DataFrame) -> DataFrame:
    """``folder, name`` of sidecars to which no file of their folder belongs, by its stem or its whole name; no sidecar owns another."""
    sidecar = F.coalesce(*[F.when(F.endswith(F.lower("name"), F.lit(s)), True) for s in SIDECARS], F.lit(False))
    told = files.select("folder", "name", sidecar.alias("is_sidecar"))
    owners = told.where("NOT is_sidecar").select("folder", F.explode(F.array(F.col("name"), stem(F.col("name")))).alias("owner")).distinct()
    asked = told.where("is_sidecar").withColumn("owner", stem(F.col("name")))
    return asked.join(owners, ["folder", "owner"], "left_anti").select("folder", "name")


def resolved_dates(fields: DataFrame, files: DataFrame) -> DataFrame:
    """``file`` with each of the five dates (epoch) and the field that gave it.

    ``fields``: file, name, epoch; ``files``: file, ctime, mtime. The earliest date of a bucket stands, of modified ones the latest; of equal
    ones the first by name. A file's own times fill digitized and modified where no field did.
    """
    told = fields.where("epoch IS NOT NULL").withColumn("bucket", date_bucket(F.col("name"))).where("bucket IS NOT NULL")
    first = F.struct(F.when(F.col("bucket") == "d_modified", -F.col("epoch")).otherwise(F.col("epoch")).alias("rank"), F.col("name").alias("source"), F.col("epoch").alias("epoch"))
    wide = told.groupBy("file").agg(*[F.min(F.when(F.col("bucket") == b, first)).alias(b) for b in DATES])
    own = {"d_digitized": ("ctime", "inode.ctime"), "d_modified": ("mtime", "inode.mtime")}
    joined = files.join(wide, "file", "left")
    out = []
    for b in DATES:
        time, source = own.get(b, (None, None))
        fallback = F.nullif(F.col(time), F.lit(0.0)) if time else F.lit(None).cast("double")
        out.append(F.coalesce(F.col(f"{b}.epoch"), fallback).alias(b))
        out.append(F.coalesce(F.col(f"{b}.source"), F.when(fallback.isNotNull(), source) if time else F.lit(None)).alias(f"{b}_source"))
    return joined.select("file", *out)


def typed_places(wants: DataFrame, towns: DataFrame, states: dict[str, str]) -> DataFrame:
    """``want, town`` of typed places (want, city, cc, state): the first town of that name, if it is clear which one is meant.

    ``towns``: town, city, cc, state, lat, lon, in the order of ``town``. A country narrows the towns of a name; so does a state (``states`` has its short forms) unless none
    is left. Towns farther than ``AMBIGUOUS_KM`` from the first one leave it open, and the place has no row. Equal wants are looked up once.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    short = F.create_map(*[F.lit(x) for pair in states.items() for x in (pair[0].lower(), pair[1].lower())]) if states else None
    asked = wants.select("want", low(F.col("city")).alias("city"), F.upper(low(F.col("cc"))).alias("cc"), low(F.col("state")).alias("state"))
    keys = stored(asked.where("city <> ''").select("city", "cc", "state").distinct(), "typed-places")
    long = F.coalesce(F.element_at(short, F.col("state")), F.col("state")) if short is not None else F.col("state")
    known = towns.select(low(F.col("city")).alias("city"), "town", F.upper(F.coalesce("cc", F.lit(""))).alias("of"), low(F.col("state")).alias("in_state"), "lat", "lon")
    met = keys.join(known, "city").where("cc = '' OR cc = of").withColumn("fits", (F.col("state") != "") & F.col("in_state").isin(F.col("state")) | (F.col("state") != "") & (F.col("in_state") == long))
    key = ["city", "cc", "state"]
    narrow = met.groupBy(*key).agg(F.max("fits").alias("narrow"))
    left = met.join(narrow, key).where("fits OR NOT narrow")
    firsts = left.groupBy(*key).agg(F.min(F.struct("town", "lat", "lon")).alias("first"))
    away = haversine(F.col("first.lat"), F.col("first.lon"), F.col("lat"), F.col("lon"))
    clear = left.join(firsts, key).groupBy(*key).agg(F.max(away).alias("away"), F.min("first.town").alias("town")).where(F.col("away") <= AMBIGUOUS_KM)
    return asked.join(clear, key).select("want", "town")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``name, score`` (0 to 1) of a label file: ``name,score`` with commas or tabs and perhaps a header, or lines with a histogram of ten votes.

    Scores above 1 are of a scale to 10, above 10 of one to 100, as the largest of the file tells. What can't be read is left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("line"))
    words = F.split("line", r"\s+")
    votes = F.transform(F.slice(words, 3, 10), lambda v: v.try_cast("double"))
    is_histogram = (F.size(words) >= 12) & F.forall(votes, lambda v: v.isNotNull())
    total = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v)
    mean = F.try_divide(F.aggregate(F.zip_with(votes, F.sequence(F.lit(1), F.lit(10)), lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v), F.when(total > 0, total))
    cells = F.split("line", "\t|,")
    plain = F.trim(F.try_element_at(cells, F.lit(2))).try_cast("double")
    rows = lines.select(F.when(is_histogram, F.get(words, F.lit(1))).otherwise(F.trim(F.get(cells, F.lit(0)))).alias("name"), F.when(is_histogram, mean).otherwise(plain).alias("score"))
    rows = stored(rows.where("score IS NOT NULL"), "label-rows")
    scale = rows.agg(F.when(F.max("score") > 10, 100.0).when(F.max("score") > 1, 10.0).otherwise(1.0).alias("scale"))
    return rows.join(F.broadcast(scale)).select("name", F.least(F.greatest(F.col("score") / F.col("scale"), F.lit(0.0)), F.lit(1.0)).alias("score"))  # one row


def shape_inliers(vectors: DataFrame, group: str, key: str, column: str, most: float = 5.0) -> DataFrame:
    """``key, inlier``: whether a vector is within ``most`` median deviations, by its distance to the middle of its group.

    The middle takes each component's median. A group whose deviation is below 0.0001 keeps all. Medians are of groups' components, one number for each.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(group, key, F.col(column).cast("array<double>").alias("v"))
    parts = rows.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.median("x").alias("m"))
    middles = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(group, F.col("c.m").alias("middle"))
    distance = F.sqrt(F.aggregate(F.zip_with("v", "middle", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, d: s + d))
    away = stored(rows.join(middles, group).select(group, key, distance.alias("d")), "shape-distances")
    spread = away.join(away.groupBy(group).agg(F.median("d").alias("half")), group).withColumn("s", F.abs(F.col("d") - F.col("half")))
    deviation = spread.groupBy(group).agg(F.median("s").alias("mad"))
    return spread.join(deviation, group).select(key, ((F.col("mad") < 1e-4) | (F.col("s") <= most * F.col("mad"))).alias("inlier"))
