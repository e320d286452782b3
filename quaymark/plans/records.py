"""Metadata rows, suggested names and uploads; documents, lines and parts stand for files, bodies and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.records import BLANKS, CUT, metadata_rows, resent_uploads, suggested_names
from quaymark.plans.registry import query, table


@query(f"""WITH d AS (SELECT *, trim(text, '{BLANKS}') AS title FROM documents), r AS (
SELECT doc_id, 'exif' AS ns, 'Make' AS tag, coalesce(source, 'not shown') AS value FROM d
UNION ALL SELECT doc_id, 'exif', 'Size', CASE WHEN doc_id % 3 > 0 OR lang IS NULL THEN n_chars::VARCHAR ELSE lang END FROM d
UNION ALL SELECT doc_id, 'iptc', 'Keywords', CASE WHEN lang IS NULL THEN 'None' ELSE lang END || ', ' || (doc_id % 7) FROM d WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'iptc', '0x9', (n_chars % 10)::VARCHAR FROM d
UNION ALL SELECT doc_id, 'xmp', 'dc:title', CASE WHEN doc_id % 5 = 0 THEN 'again' ELSE title END FROM d)
SELECT doc_id, ns, tag, left(value, {CUT}) AS value FROM r WHERE value <> ''""")
def metadata_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three readers tell of each document, as long rows."""
    field = lambda name, present, **values: F.struct(F.lit(name).alias("name"), present.alias("present"), *[v.alias(k) for k, v in values.items()])
    every, c = F.lit(True), F.col
    make = field("Make", every, display=c("source"), raw=F.lit("not shown"))
    size = field("Size", every, display=F.when(c("doc_id") % 3 == 0, c("lang")), raw=c("n_chars").cast("string"))
    exif = F.struct(F.array(F.struct(F.array(make, size).alias("fields"))).alias("groups"))
    keywords = field("Keywords", c("doc_id") % 2 == 0, display=F.array("lang", (c("doc_id") % 7).cast("string")))
    unknown = F.struct(F.lit("0x9").alias("name"), (c("n_chars") % 10).alias("raw"))
    iptc = F.struct(F.array(F.struct(F.array(keywords).alias("fields"), F.array(unknown).alias("unknown"))).alias("records"))
    title = lambda present, value: F.struct(F.lit("dc").alias("ns"), F.array(field("title", present, display=value)).alias("fields"))
    xmp = F.struct(F.array(title(every, c("text")), title(c("doc_id") % 5 == 0, F.lit("again"))).alias("namespaces"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(exif).alias("exif"), F.to_json(iptc).alias("iptc"), F.to_json(xmp).alias("xmp"))
    return metadata_rows(docs, "doc_id", {x: x for x in ("exif", "iptc", "xmp")})


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey AS face, l_suppkey % 40 - 2 AS cluster, l_suppkey % 40 % 3 = 0 AND l_orderkey % 5 = 0 AS confirmed,
  CASE WHEN l_suppkey % 40 % 3 = 0 AND l_orderkey % 5 = 0 THEN 'own' || (l_orderkey % 3) ELSE 'old' END AS name FROM lineitem),
f AS (SELECT p_partkey AS face, CASE WHEN p_partkey % 4 > 0 THEN p_brand ELSE '' END AS name FROM part),
k AS (SELECT cluster, min(name) AS name FROM b WHERE cluster >= 0 AND confirmed AND name <> '' GROUP BY 1),
n AS (SELECT cluster, f.name, count(*) AS n FROM b JOIN f USING (face) WHERE cluster >= 0 AND f.name <> '' GROUP BY ALL),
m AS (SELECT cluster, arg_min(name, (-n, name)) AS name FROM n GROUP BY 1)
SELECT l_orderkey, l_linenumber, cluster, CASE WHEN confirmed THEN b.name ELSE coalesce(k.name, m.name, b.name) END AS name FROM b LEFT JOIN k USING (cluster) LEFT JOIN m USING (cluster)""")
def borrowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the bodies of a cluster: a confirmed one, else the one that most of their faces have."""
    confirmed = (F.col("l_suppkey") % 40 % 3 == 0) & (F.col("l_orderkey") % 5 == 0)
    bodies = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("face"), (F.col("l_suppkey") % 40 - 2).alias("cluster"), confirmed.alias("confirmed"),
        F.when(confirmed, F.concat(F.lit("own"), (F.col("l_orderkey") % 3).cast("string"))).otherwise("old").alias("name"),
    )
    faces = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("face"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).otherwise("").alias("name"))
    return suggested_names(bodies, faces).select("l_orderkey", "l_linenumber", "cluster", "name")


@query("""WITH p AS (SELECT *, p_name || '/' || p_size AS base, row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) - 1 AS n FROM part),
s AS (SELECT base, n, base || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.jpg' AS path, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) || '.cr2' ELSE '' END AS source FROM p WHERE p_partkey % 13 > 0),
c AS (SELECT * FROM s WHERE n <= 998 AND n = (SELECT count(*) FROM s t WHERE t.base = s.base AND t.n < s.n)),
f AS (SELECT base, source, arg_min(path, n) AS path FROM c GROUP BY ALL),
u AS (SELECT l_orderkey, l_linenumber, p_name || '/' || p_size AS base, CASE WHEN l_linenumber % 2 = 0 THEN 'brand#' || (1 + l_suppkey % 25) || '.cr2' ELSE '' END AS source FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, path FROM u JOIN f USING (base, source)""")
def upload_resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the library that uploads are sent again of."""
    base = F.concat_ws("/", "p_name", F.col("p_size").cast("string"))
    n = F.row_number().over(Window.partitionBy("p_name", "p_size").orderBy("p_partkey")) - 1
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", base.alias("base"), n.alias("n"))
    path = F.concat("base", F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".jpg"))
    stored = parts.where("p_partkey % 13 > 0").select(path.alias("path"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(".CR2 "))).alias("raw_name"))
    raw = F.col("l_linenumber") % 2 == 0
    origin = F.when(raw, F.concat(F.lit("BRAND#"), (1 + F.col("l_suppkey") % 25).cast("string"), F.lit(".cr2"))).otherwise("shot.jpg")
    sent = table(spark, sf_dir, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), F.concat("base", F.lit(".jpg")).alias("path")), "l_partkey")
    uploads = sent.select(F.struct("l_orderkey", "l_linenumber").alias("upload"), "path", origin.alias("origin"), raw.alias("raw"))
    return resent_uploads(uploads, stored).select("upload.*", "path")
