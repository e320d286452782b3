"""Rules over files: names, dates, tags, texts, towns, labels, outliers, verdicts on boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.html import html_to_text
from quaymark.functions.rules import (
    compared, engagement, filled_in, folder_of, gated, listed, matched, page_verdict, sidecar_changed, stem_keys, temporary, text_verdict, truthy, without_boilerplate,
)
from quaymark.operators.boxes import box_diff
from quaymark.operators.files import orphan_sidecars, read_labels, resolved_dates, shape_inliers, typed_places
from quaymark.plans.registry import query, table
from quaymark.sources.shared import new_path

_S = r"[ \t\n\r\x0b\x0c]"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '^{_S}+|{_S}+$', '', 'g') AS whole FROM documents),
c AS (SELECT *, len(regexp_extract_all(split_part(whole, chr(10) || chr(10), 1), ',')) >= 3 AND len(whole) - len(replace(whole, chr(10), '')) <= 2 AND len(regexp_extract_all(whole, '[.!?]["'')\]]?{_S}')) = 0 AS tagline FROM d)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'sidecar' WHEN size < 512 THEN 'sidecar' WHEN size < 4096 AND tagline THEN 'sidecar' WHEN size < 4096 THEN 'triage'
WHEN len(regexp_extract_all(text, '[A-Za-z'']+')) < 50 THEN 'triage' ELSE 'book' END AS verdict FROM c""")
def text_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents are books, tag lists of files beside them (every tenth has one) or for a person to look at."""
    docs = table(spark, sf_dir, "documents")
    found = text_verdict(F.octet_length(F.coalesce("text", F.lit(""))), F.col("text"), F.col("doc_id") % 10 == 0)
    return docs.select("doc_id", found["verdict"].alias("verdict"))


@query()
def page_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are stories, saved or index pages, or for a person to look at; every ninth lies in an unpacked book."""
    pages = table(spark, sf_dir, "pages").withColumn("text", html_to_text(F.col("html")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    found = page_verdict(size, F.col("html"), F.col("text"), F.col("page_id") % 8 == 0, F.col("page_id") % 7 == 0, F.col("page_id") % 9 == 0)
    return pages.select("page_id", found["verdict"].alias("verdict"), found["reason"].alias("reason"))


@query(r"""WITH n AS (SELECT p_partkey, 'lib/' || lower(p_brand) || '/' || CASE WHEN p_partkey % 6 = 0 THEN '~$' ELSE '' END || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 4 = 0 THEN '_' || p_size ELSE '' END || '.v1' || CASE p_partkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.PART' WHEN 2 THEN '.tmp' ELSE '.png' END AS path FROM part)
SELECT p_partkey, regexp_extract(path, '^(.*)/', 1) AS folder, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')) AS key, regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')), '_[0-9]+$', '') AS key2,
CASE WHEN p_partkey % 6 = 0 THEN '~$' WHEN p_partkey % 5 = 1 THEN '.part' WHEN p_partkey % 5 = 2 THEN '.tmp' END AS leftover FROM n""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder, match keys and leftover marks of paths."""
    n = F.col("p_partkey")
    copy = F.when(n % 4 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")
    ext = F.when(n % 5 == 0, ".JPG").when(n % 5 == 1, ".PART").when(n % 5 == 2, ".tmp").otherwise(".png")
    path = F.concat(F.lit("lib/"), F.lower("p_brand"), F.lit("/"), F.when(n % 6 == 0, "~$").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), copy, F.lit(".v1"), ext)
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumns({"k": stem_keys(F.col("path")), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    return rows.select("p_partkey", folder_of(F.col("path")).alias("folder"), "k.key", "k.key2", temporary(F.col("name")).alias("leftover"))


@query("""WITH f AS (SELECT 'd' || p_size AS folder, p_name || CASE p_partkey % 6 WHEN 0 THEN '.xmp' WHEN 1 THEN '.jpg.xmp' WHEN 2 THEN '.txt' ELSE '.jpg' END AS name FROM part),
o AS (SELECT folder, name AS owner FROM f WHERE name NOT LIKE '%.xmp' AND name NOT LIKE '%.txt' UNION SELECT folder, replace(name, '.jpg', '') FROM f WHERE name NOT LIKE '%.xmp' AND name NOT LIKE '%.txt'),
s AS (SELECT folder, name, regexp_replace(name, '[.][a-z]+$', '') AS owner FROM f WHERE name LIKE '%.xmp' OR name LIKE '%.txt')
SELECT folder, name, count(*) AS n FROM s ANTI JOIN o USING (folder, owner) GROUP BY ALL""")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars whose files are gone."""
    n = F.col("p_partkey") % 6
    ext = F.when(n == 0, ".xmp").when(n == 1, ".jpg.xmp").when(n == 2, ".txt").otherwise(".jpg")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("folder"), F.concat("p_name", ext).alias("name"))
    return orphan_sidecars(files).groupBy("folder", "name").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, event_id * 10.0 AS side, event_id * 10.0 + (event_id % 5) - 2 AS own, CASE WHEN event_id % 4 > 0 THEN event_id * 10.0 - (event_id % 3) / 200.0 END AS seen FROM events)
SELECT event_id, coalesce(side > 0 AND seen IS NOT NULL AND side > 500 AND side - seen >= 0.01 AND side > own, false) AS changed FROM t""")
def changed_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars that changed outside since they were last seen."""
    n = F.col("event_id")
    side = n * F.lit(10.0)
    seen = F.when(n % 4 > 0, side - n % 3 / 200)
    return table(spark, sf_dir, "events").select("event_id", sidecar_changed(side, side + n % 5 - 2, seen, F.lit(500.0)).alias("changed"))


_FIELDS = ("Exif.Image.DateTime", "Exif.Photo.DateTimeDigitized", "Xmp.xmp.CreateDate", "Xmp.photo.CaptureTime", "Iptc.App.TimeZone", "Xmp.xmp.ModifyDate", "Xmp.exif.DateTimeOriginal", "Iptc.Time.Original")
_BUCKETS = ("d_actual", "d_digitized", "d_actual", "d_capture", None, "d_modified", "d_original", "d_original")
_LIST = ", ".join(f"'{f}'" for f in _FIELDS)
_MAP = ", ".join(f"'{b}'" if b else "NULL" for b in _BUCKETS)


@query(f"""WITH f AS (SELECT l_orderkey AS file, [{_LIST}][1 + l_linenumber % 8] AS name, [{_MAP}][1 + l_linenumber % 8] AS bucket, CASE WHEN l_quantity > 3 THEN epoch(l_shipdate) END AS t FROM lineitem),
k AS (SELECT file, bucket, CASE WHEN bucket = 'd_modified' THEN max(t) ELSE min(t) END AS t FROM f WHERE t IS NOT NULL AND bucket IS NOT NULL GROUP BY file, bucket),
s AS (SELECT f.file, f.bucket, k.t, min(name) AS source FROM f JOIN k ON k.file = f.file AND k.bucket = f.bucket AND k.t = f.t GROUP BY ALL),
w AS (SELECT file, {", ".join(f"max(t) FILTER (bucket = '{b}') AS {b}, max(source) FILTER (bucket = '{b}') AS {b}_source" for b in ("d_actual", "d_original", "d_capture", "d_digitized", "d_modified"))} FROM s GROUP BY 1),
o AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 3 > 0 THEN epoch(o_orderdate) ELSE 0 END AS ctime, epoch(o_orderdate) + 60 AS mtime FROM orders)
SELECT o.file, d_actual, d_actual_source, d_original, d_original_source, d_capture, d_capture_source, coalesce(d_digitized, nullif(ctime, 0)) AS d_digitized,
coalesce(d_digitized_source, CASE WHEN ctime <> 0 THEN 'inode.ctime' END) AS d_digitized_source, coalesce(d_modified, mtime) AS d_modified, coalesce(d_modified_source, 'inode.mtime') AS d_modified_source FROM o LEFT JOIN w USING (file)""")
def file_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dates of files out of their fields: orders are files, lines their fields."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    names = F.array(*map(F.lit, _FIELDS))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.get(names, F.col("l_linenumber") % 8).alias("name"), F.when(F.col("l_quantity") > 3, seconds("l_shipdate")).alias("epoch"))
    files = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 3 > 0, seconds("o_orderdate")).otherwise(0.0).alias("ctime"), (seconds("o_orderdate") + 60).alias("mtime")
    )
    return resolved_dates(fields, files)


@query("""WITH r AS (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type, event_id % 3 AS m FROM events)
SELECT event_id, (k * 1000)::DOUBLE AS up, CASE WHEN m > 0 THEN k::DOUBLE END AS down, CASE WHEN m = 1 THEN (k + 0.5)::DOUBLE END AS views, event_type AS source FROM r""")
def engagement_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sources out of tags of events."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.col("event_id") % 3
    tags = F.array(
        F.concat(F.lit("Score_Up : "), F.format_number(k * 1000, 0)), F.when(m > 0, F.concat(F.lit("score_down="), k.cast("string"))).otherwise("score_down: many"),
        F.when(m == 1, F.concat(F.lit(" views: "), (k + 0.5).cast("string"), F.lit(" "))), F.lit("source: old"), F.concat(F.lit("SITE = "), F.upper("event_type")), F.lit("tree"),
    )
    return table(spark, sf_dir, "events").select("event_id", engagement(tags).alias("e")).select("event_id", "e.up", "e.down", "e.views", "e.source")


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN ' No ' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_type END AS flag FROM part)
SELECT p_partkey, coalesce(lower(trim(flag)), '') NOT IN ('', 'no', 'false', '0', 'none', 'null') AS truthy, nullif(regexp_extract(p_name, '(?i)^RE([a-z])', 1), '') AS found,
p_name || ' of ' || p_brand || ' [' || coalesce(flag, '') || ', ' || p_size || ']' AS text, contains(lower(p_name), 'ring') AS contains_ring, lower(trim(coalesce(flag, ''))) = 'no' AS equals_no, regexp_matches(p_name, '(?i)^B.*E ') AS matches,
CASE WHEN coalesce(lower(trim(flag)), '') IN ('', 'no', 'false', '0', 'none', 'null') THEN p_brand END AS gated FROM p""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text nodes of a graph: truth, patterns, templates, lists, comparisons, a gate that is turned round."""
    flag = F.when(F.col("p_partkey") % 4 == 0, " No ").when(F.col("p_partkey") % 4 == 1, None).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").withColumn("flag", flag)
    sizes = listed(F.array(F.coalesce("flag", F.lit("")), F.lit(None).cast("string"), F.col("p_size").cast("string")))
    return rows.select(
        "p_partkey", truthy(F.col("flag")).alias("truthy"), matched(F.col("p_name"), "^RE([a-z])", 1).alias("found"), filled_in("{a} of {b} [{c}]", a=F.col("p_name"), b=F.col("p_brand"), c=sizes).alias("text"),
        compared(F.col("p_name"), "contains", "RING").alias("contains_ring"), compared(F.col("flag"), "equals", "NO").alias("equals_no"), compared(F.col("p_name"), "matches", "^B.*E ").alias("matches"),
        gated(F.col("p_brand"), F.col("flag"), invert=True).alias("gated"),
    )


@query("""WITH w AS (SELECT c_custkey AS want, 'town ' || (c_custkey % 23) AS city, CASE WHEN c_custkey % 3 = 0 THEN 'C' || (c_nationkey % 2) ELSE '' END AS cc, CASE c_custkey % 4 WHEN 0 THEN 'state 1' WHEN 1 THEN 'state 2' WHEN 2 THEN 'nowhere' ELSE '' END AS state FROM customer),
t AS (SELECT s_suppkey AS town, 'town ' || (s_suppkey % 20) AS city, 'C' || (s_suppkey // 20 % 2) AS cc, 'state ' || (1 + s_suppkey // 40 % 2) AS state, (s_suppkey % 20) * 2.0 + (s_suppkey // 40) * 0.3 AS lat, (s_suppkey // 20 % 2) * 1.1 + (s_suppkey // 60) * 0.2 AS lon FROM supplier),
m AS (SELECT w.*, town, t.state AS ts, lat, lon FROM w JOIN t ON w.city = t.city AND (w.cc = '' OR w.cc = t.cc)),
n AS (SELECT *, max(ts = state) OVER (PARTITION BY want) AS narrow FROM m), l AS (SELECT * FROM n WHERE ts = state OR NOT narrow),
f AS (SELECT *, first_value(lat) OVER o AS lat1, first_value(lon) OVER o AS lon1, first_value(town) OVER o AS first FROM l WINDOW o AS (PARTITION BY want ORDER BY town))
SELECT want, first AS town FROM f GROUP BY want, first HAVING max(2 * 6371 * asin(sqrt(pow(sin(radians(lat - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat)) * pow(sin(radians(lon - lon1) / 2), 2)))) <= 100""")
def towns_meant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places of customers among the towns of suppliers, where it is clear which one is meant."""
    n, s = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    state = F.when(n % 4 == 0, " S1").when(n % 4 == 1, "state 2").when(n % 4 == 2, "nowhere")
    wants = table(spark, sf_dir, "customer").select(n.alias("want"), F.concat(F.lit("Town "), text(n % 23)).alias("city"), F.when(n % 3 == 0, F.concat(F.lit("c"), text(F.col("c_nationkey") % 2))).alias("cc"), state.alias("state"))
    towns = table(spark, sf_dir, "supplier").select(
        s.alias("town"), F.concat(F.lit("town "), text(s % 20)).alias("city"), F.concat(F.lit("C"), text(F.floor(s / 20) % 2)).alias("cc"), F.concat(F.lit("State "), text(1 + F.floor(s / 40) % 2)).alias("state"),
        (s % 20 * 2.0 + F.floor(s / 40) * 0.3).alias("lat"), (F.floor(s / 20) % 2 * 1.1 + F.floor(s / 60) * 0.2).alias("lon"),
    )
    return typed_places(wants, towns, {"S1": "State 1"})


@query("""WITH v AS (SELECT doc_id, (quality + doc_id) % 10 AS best, coalesce(toxic, 0) AS t FROM labels WHERE doc_id % 9 > 0),
h AS (SELECT doc_id, sum(i * (CASE WHEN i = 1 + best THEN 20 ELSE (i + t) % 3 END)) / sum(CASE WHEN i = 1 + best THEN 20 ELSE (i + t) % 3 END) AS mean FROM v, range(1, 11) r(i) GROUP BY 1)
SELECT 'img' || doc_id AS name, round(mean / 10, 9)::DOUBLE AS score FROM h""")
def vote_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of ten votes, written as a label file of lines and read back as scores."""
    path = new_path(spark, "vote-labels")
    best, t = (F.col("quality") + F.col("doc_id")) % 10, F.coalesce("toxic", F.lit(0))
    votes = [F.when(best + 1 == i, 20).otherwise((F.lit(i) + t) % 3).cast("string") for i in range(1, 11)]
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.concat(F.lit("img"), F.col("doc_id").cast("string")), *votes, F.lit("7 tag"))
    rows = table(spark, sf_dir, "labels")
    rows.select(F.when(F.col("doc_id") % 9 > 0, line).otherwise("unreadable line").alias("value")).write.text(path)
    return read_labels(spark, path).select("name", F.round("score", 9).alias("score"))


@query("""WITH x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, i, median(v) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT vec_id, label, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM embeddings JOIN c USING (label)),
h AS (SELECT label, median(d) AS half FROM d GROUP BY 1), s AS (SELECT vec_id, label, abs(d - half) AS s FROM d JOIN h USING (label)), k AS (SELECT label, median(s) AS mad FROM s GROUP BY 1)
SELECT vec_id, mad < 1e-4 OR s <= 2.5 * mad AS inlier FROM s JOIN k USING (label)""")
def vector_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are not too far from the middle of their label, by median deviations."""
    return shape_inliers(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 2.5)


@query()
def box_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of true boxes in a model's guesses: a guess is a line's box moved and sized by other columns, or of another kind."""
    lines = table(spark, sf_dir, "lineitem")
    cx, cy, w, h = F.lit(0.1) + F.col("l_discount") * 8, F.lit(0.1) + F.col("l_tax") * 10, F.lit(0.1) + F.col("l_quantity") / 100, F.lit(0.1) + F.col("l_partkey") % 40 / 100
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")
    truth = lines.where("l_partkey % 9 > 0").select(F.col("l_orderkey").alias("image"), key, F.col("l_linestatus").alias("kind"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    size, kind = F.lit(0.7) + F.col("l_suppkey") % 7 / 10, F.when(F.col("l_suppkey") % 6 == 0, "F").otherwise(F.col("l_linestatus"))
    guesses = lines.where("l_partkey % 8 > 0").select(
        F.col("l_orderkey").alias("image"), key, kind.alias("kind"), (cx + F.col("l_suppkey") % 4 / 40).alias("cx"), cy.alias("cy"), (w * size).alias("w"), h.alias("h")
    )
    return box_diff(truth, guesses).select("image", "verdict", "kind", F.round("overlap", 6).alias("overlap"), "gt", "pred", "confused_with")


START, END = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THIS PROJECT GUTENBERG EBOOK X ***"


@query("""SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 2 THEN chr(10) || 'tail' ELSE '' END) AS body FROM documents""")
def book_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books without the lines around them: some have both, some the first alone, some none."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    tail = F.when(kind == 0, F.concat(F.lit(END), F.lit("\nlicense"))).when(kind == 2, "\ntail").otherwise("")
    book = F.concat(F.when(kind < 2, F.concat(F.lit("Produced by\n"), F.lit(START))).otherwise(""), text, tail)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(without_boilerplate(book), 256).alias("body"))
