"""Metadata as long rows, names that spread over clusters, uploads that were here before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest value of a metadata row.
CUT = 2000
#: Copies of a name that are looked at: the name itself and those numbered up to this.
COPIES = 998
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_GROUPS = "array<struct<ns string, fields array<struct<name string, present boolean, display variant, raw variant>>, unknown array<struct<name string, raw variant>>>>"
_READING = f"groups {_GROUPS}, records {_GROUPS}, namespaces {_GROUPS}"


def _spelt(value: Column) -> Column:
    """A reading as text: the elements of a list joined by commas, null for JSON's null."""
    listed = F.schema_of_variant(value).startswith("ARRAY")
    elements = F.transform(F.try_variant_get(value, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("None")))
    return F.when(F.is_variant_null(value), None).when(listed, F.array_join(elements, ", ")).otherwise(F.try_variant_get(value, "$", "string"))


def metadata_rows(files: DataFrame, key: str, readings: dict[str, str]) -> DataFrame:
    """``key, ns, tag, value``: what readers found in files, a row for each tag.

    ``readings`` has for each namespace the column with the reader's JSON: ``groups``, ``records`` or ``namespaces`` with ``fields`` (name,
    present, display, raw) and ``unknown`` (name, raw). ``display`` stands before ``raw``, a prefix ``ns`` before the tag of ``xmp``; values
    are cut at ``CUT`` characters. Of a tag that is read twice the last value stands. Absent, null and blank values, null
    tags and JSON that can't be parsed give no rows. Numbers are spelt as in the JSON, without trailing zeros. A row is made from its file alone: nothing is shuffled.
    """
    found = []
    for ns, column in readings.items():
        reading = F.from_json(column, _READING)
        groups = F.coalesce(reading["groups"], reading["records"], reading["namespaces"])
        prefix = lambda g, ns=ns: F.when(F.lit(ns == "xmp") & (g["ns"] != ""), F.concat(g["ns"], F.lit(":"))).otherwise("")
        seen = lambda g: F.transform(
            F.filter(F.coalesce(g["fields"], F.array()), lambda f: f["present"]),
            lambda f: F.struct(F.concat(prefix(g), f["name"]).alias("tag"), F.trim(_spelt(F.coalesce(f["display"], f["raw"])), F.lit(BLANKS)).alias("value")),
        )
        odd = lambda g: F.transform(
            F.coalesce(g["unknown"], F.array()), lambda u: F.struct(F.concat(prefix(g), u["name"]).alias("tag"), _spelt(u["raw"]).alias("value"))
        )
        every = F.flatten(F.transform(groups, lambda g: F.concat(seen(g), odd(g))))
        found.append(F.struct(F.lit(ns).alias("ns"), every.alias("rows")))
    one = files.select(key, F.explode(F.array(*found)).alias("of"))
    told = F.filter("of.rows", lambda r: r["tag"].isNotNull() & (r["value"] != ""))
    # the last of equal tags stands behind the others
    placed = F.array_sort(F.transform(told, lambda r, i: F.struct(r["tag"].alias("tag"), i.alias("at"), r["value"].alias("value"))))
    ordered = one.select(key, "of.ns", placed.alias("rows"))
    last = F.filter("rows", lambda r, i: ~F.get("rows", i + 1)["tag"].eqNullSafe(r["tag"]))
    return ordered.select(key, "ns", F.explode(last).alias("row")).select(key, "ns", "row.tag", F.substring("row.value", 1, CUT).alias("value"))


def suggested_names(bodies: DataFrame, faces: DataFrame) -> DataFrame:
    """``bodies`` with ``name`` filled in for members of clusters that are not confirmed.

    ``bodies``: cluster, confirmed, name, face; ``faces``: face (once each), name. A confirmed name of the cluster (the least one) comes first, then the
    name that most of its bodies' faces have (of equally many the least). Where there is neither, and outside clusters (negative or null), names
    stay. Faces are counted by cluster and face before they are looked up, so that a large cluster moves one row for each face.
    """
    clustered = bodies.where("cluster >= 0")
    confirmed = clustered.where("confirmed AND name <> ''").groupBy("cluster").agg(F.min("name").alias("_confirmed"))
    linked = clustered.where("face IS NOT NULL").groupBy("cluster", "face").agg(F.count("*").alias("n"))
    named = linked.join(faces.where("name <> ''").select("face", "name"), "face").groupBy("cluster", "name").agg(F.sum("n").alias("n"))
    lent = named.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("less"), "name"))["name"].alias("_lent"))
    name = F.when(F.col("confirmed"), F.col("name")).otherwise(F.coalesce("_confirmed", "_lent", "name"))
    return bodies.join(confirmed.join(lent, "cluster", "full"), "cluster", "left").select(*[name.alias(c) if c == "name" else c for c in bodies.columns])


def _parts(path: str) -> dict[str, Column]:
    """A path without its extension, and the extension; the dots that a name begins with are part of the name."""
    pattern = r"^((?:.*/)?\.*[^/]*?)(\.[^./]*)?$"
    return {"base": F.regexp_extract(path, pattern, 1), "ext": F.regexp_extract(path, pattern, 2)}


def resent_uploads(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """``upload, path``: the stored file that an upload is sent again of; uploads that are new have no row.

    ``uploads``: upload, path (as predicted), origin (the name it came with), raw; ``stored``: path, raw_name (of the raw it was made from, null or empty if from
    none). The file under the predicted path is looked at, then ``base_1``, ``base_2`` and so on, until a name is free. A raw is the
    same as the first file made from a raw of its name, anything else as the first file made from none. The first files of each name and source are found once,
    so an upload meets one row at most, however many share its name. A name has ``COPIES`` numbers at most, so a window holds no more.
    """
    files = stored.where("path IS NOT NULL").groupBy("path").agg(F.min(F.lower(F.trim(F.coalesce("raw_name", F.lit(""))))).alias("source")).withColumns(_parts("path"))
    number = F.regexp_extract("base", "_([1-9][0-9]{0,2})$", 1)
    plain = files.select("path", "source", "base", "ext", F.lit(0).alias("n"))
    numbered = files.where(number != "").select("path", "source", F.regexp_replace("base", "_[0-9]+$", "").alias("base"), "ext", number.cast("int").alias("n"))
    family = plain.union(numbered.where(F.col("n") <= COPIES))
    taken = family.groupBy("base", "ext").agg(F.array_sort(F.collect_set("n")).alias("numbers"))
    # numbers that are as large as their place follow each other from the first on
    unbroken = taken.select("base", "ext", F.size(F.filter("numbers", lambda n, i: n == i)).alias("until"))
    first = family.join(unbroken, ["base", "ext"]).where("n < until").groupBy("base", "ext", "source").agg(F.min_by("path", "n").alias("found"))
    source = F.when(~F.coalesce("raw", F.lit(False)), "").otherwise(F.nullif(F.lower(F.trim("origin")), F.lit("")))
    asked = uploads.select("upload", "path", source.alias("source")).withColumns(_parts("path")).drop("path")
    return asked.join(first, ["base", "ext", "source"]).select("upload", F.col("found").alias("path"))
