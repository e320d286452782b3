"""Routes, poses, and sequences that share steps or run at an offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.operators.assignments import pose_subjects
from quaymark.operators.media import indexed_passages, shared_kept_pairs, voted_candidates, voted_offsets
from quaymark.operators.neighbours import unit_rows
from quaymark.operators.routes import cluster_count, kmeans_labels, route
from quaymark.operators.sequences import dtw_paths, resampled
from quaymark.plans.registry import query, table
from quaymark.sources.shared import stored

#: Members of a half whose path is traced back, and the band of longer ones.
STEPS, BAND = 512, 64


@query()
def playlist_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One walk through all vectors, from the first one on."""
    units = stored(unit_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "route-units")
    n, first = units.agg(F.count("*"), F.min("key")).first()
    if n <= 3:
        return units.select(F.col("key").alias("vec_id"), F.lit(0).alias("cluster"), (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("place"))
    labelled = stored(kmeans_labels(units, cluster_count(n)), "route-labels")
    return route(labelled, first).withColumnRenamed("key", "vec_id")


_OFFSETS = [(-0.3, -0.4), (0.3, -0.4), (0.0, 0.0), (-0.3, 0.45), (0.3, 0.45)]
_SQL_POINTS = ", ".join(f"{{'x': cx + w * {x}, 'y': cy + h * {y}, 'v': (l_orderkey + l_linenumber * {i + 1}) % 7 / 7.0}}" for i, (x, y) in enumerate(_OFFSETS))


@query(f"""WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 10 + l_linenumber) AS key, 0.15 + l_discount * 6 AS cx, 0.15 + l_tax * 7 AS cy, 0.15 + l_quantity / 150 AS w, 0.15 + (l_partkey % 50) / 150.0 AS h FROM lineitem),
d AS (SELECT DISTINCT l_orderkey AS image, key AS box, cx, cy, w, h FROM l WHERE l_linenumber % 2 = 1),
q AS (SELECT DISTINCT l_orderkey AS image, key AS person, list_filter([{_SQL_POINTS}], lambda p: p.v >= 0.2) AS seen FROM l WHERE l_linenumber % 2 = 0),
s AS (SELECT d.image, box, person, CASE WHEN len(seen) > 0 THEN len(list_filter(seen, lambda p: abs(p.x - cx) <= w / 2 AND abs(p.y - cy) <= h / 2)) / len(seen) ELSE 0 END AS share FROM d JOIN q USING (image)),
t AS (SELECT image, box, row_number() OVER (PARTITION BY image ORDER BY box) AS rn FROM (SELECT DISTINCT image, box FROM s WHERE share > 0)),
r(image, rn, used, box, person) AS (SELECT DISTINCT image, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT FROM t
  UNION ALL SELECT image, rn, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, box, best FROM
  (SELECT r.image, t.rn, r.used, t.box, (SELECT CASE WHEN x.share >= 0.4 THEN x.person END FROM s x WHERE x.box = t.box AND x.image = t.image AND x.share > 0 AND NOT list_contains(r.used, x.person) ORDER BY x.share DESC, x.person LIMIT 1) AS best
   FROM r JOIN t ON t.image = r.image AND t.rn = r.rn + 1)),
m AS (SELECT image, box, person FROM r WHERE person IS NOT NULL),
f AS (SELECT image, person, greatest(0, list_min(list_transform(seen, lambda p: p.x)) - 0.03) AS x1, least(1, list_max(list_transform(seen, lambda p: p.x)) + 0.03) AS x2,
  greatest(0, list_min(list_transform(seen, lambda p: p.y)) - 0.03) AS y1, least(1, list_max(list_transform(seen, lambda p: p.y)) + 0.03) AS y2
  FROM q ANTI JOIN m USING (image, person) WHERE len(seen) >= 2)
SELECT image, box, person, person IS NULL AS needs_review, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM d LEFT JOIN m USING (image, box)
UNION ALL SELECT image, NULL, person, false, round((x1 + x2) / 2, 6), round((y1 + y2) / 2, 6), round(x2 - x1, 6), round(y2 - y1, 6) FROM f WHERE x2 - x1 >= 0.001 AND y2 - y1 >= 0.001""")
def pose_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector boxes and skeletons of images, matched one to one."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_linenumber",
        (F.lit(0.15) + F.col("l_discount") * 6).alias("cx"), (F.lit(0.15) + F.col("l_tax") * 7).alias("cy"),
        (F.lit(0.15) + F.col("l_quantity") / 150).alias("w"), (F.lit(0.15) + F.col("l_partkey") % 50 / 150).alias("h"),
    )
    boxes = lines.where("l_linenumber % 2 = 1").select("image", F.col("key").alias("box"), "cx", "cy", "w", "h").distinct()
    point = lambda i, x, y: F.struct(
        (F.col("cx") + F.col("w") * x).alias("x"), (F.col("cy") + F.col("h") * y).alias("y"), ((F.col("image") + F.col("l_linenumber") * (i + 1)) % 7 / 7).alias("v")
    )
    poses = lines.where("l_linenumber % 2 = 0").select("image", F.col("key").alias("person"), F.array(*[point(i, x, y) for i, (x, y) in enumerate(_OFFSETS)]).alias("points")).distinct()
    found = pose_subjects(boxes, poses)
    return found.select("image", "box", "person", "needs_review", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(l), 24)) // 24 AS nth, l FROM l),
w AS (SELECT doc_id, nth, unnest(list_distinct(l[nth * 24 + 1 : nth * 24 + 24])) AS word FROM g),
x AS (SELECT doc_id, nth, ('0x' || md5(word)[1:16])::UBIGINT AS h FROM w), k AS (SELECT unnest(range(64))::UTINYINT AS i),
v AS (SELECT doc_id, nth, i, 2 * sum((h >> i) & 1) > count(h) AS b FROM x, k GROUP BY ALL),
f AS (SELECT doc_id, nth, coalesce(sum(CASE WHEN b THEN 1::HUGEINT << i::HUGEINT END), 0)::UBIGINT AS h FROM v GROUP BY 1, 2),
o AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS rn FROM f WHERE bit_count(h) > 3 AND bit_count(h) < 61),
z(doc_id, rn, last, kept) AS (SELECT doc_id, rn, h, [h] FROM o WHERE rn = 1 UNION ALL
  SELECT z.doc_id, o.rn, CASE WHEN bit_count(xor(o.h, z.last)) <= 2 THEN z.last ELSE o.h END, CASE WHEN bit_count(xor(o.h, z.last)) <= 2 THEN z.kept ELSE list_append(z.kept, o.h) END
  FROM z JOIN o ON o.doc_id = z.doc_id AND o.rn = z.rn + 1),
e AS (SELECT doc_id, arg_max(kept, rn) AS kept FROM z GROUP BY 1),
c AS (SELECT kept, min(doc_id) AS first FROM e GROUP BY kept),
s AS (SELECT first, len(kept) AS size, unnest(kept) AS h FROM c),
n AS (SELECT first, size, h, count(*) AS m FROM s GROUP BY ALL)
SELECT x.first AS a, y.first AS b, sum(x.m * y.m)::BIGINT AS shared FROM n x JOIN n y ON x.first < y.first AND bit_count(xor(x.h, y.h)) <= 5
GROUP BY x.first, y.first, x.size, y.size HAVING sum(x.m * y.m) >= least(2, x.size, y.size)""")
def shared_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences of passages: pairs that share enough near ones."""
    return shared_kept_pairs(indexed_passages(table(spark, sf_dir, "documents"), "doc_id", "text", 24))[0]


_TRACKS = "(SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, round(value * 100)::BIGINT % 4096 AS v FROM events)"
_CANDIDATES = f"""t AS {_TRACKS}, p AS (SELECT * FROM t WHERE v NOT IN (0, 4294967295) AND (((v * 2654435761) >> 16) & 65535) % 8 = 0),
k AS (SELECT v FROM p GROUP BY v HAVING count(*) BETWEEN 2 AND 32),
c AS (SELECT DISTINCT a, b FROM (SELECT x.track AS a, y.track AS b, floor((y.pos - x.pos) / 4) AS bucket FROM p x JOIN p y USING (v) JOIN k USING (v) WHERE x.track < y.track) GROUP BY a, b, bucket HAVING count(*) >= 2)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.round(F.col("value") * 100).cast("long") % 4096
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("position"), value.alias("value"))


@query(f"WITH {_CANDIDATES} SELECT a, b FROM c")
def voted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tracks whose sampled values vote for one offset."""
    return voted_candidates(_tracks(spark, sf_dir), votes=2)


@query(f"""WITH {_CANDIDATES}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, v ORDER BY pos) AS nth FROM t WHERE v NOT IN (0, 4294967295)) WHERE nth <= 8),
o AS (SELECT a, b, y.pos - x.pos AS d, count(*) AS n FROM c JOIN t x ON x.track = a JOIN e y ON y.track = b AND y.v = x.v WHERE x.v NOT IN (0, 4294967295) GROUP BY ALL),
h AS (SELECT a, b, floor(d / 2) AS half, sum(n) AS n FROM o GROUP BY ALL), m AS (SELECT a, b, arg_min(half, (-n, half)) * 2 AS spot FROM h GROUP BY ALL)
SELECT a, b, arg_min(d, (-n, d)) AS "offset" FROM o JOIN m USING (a, b) WHERE d BETWEEN spot - 2 AND spot + 3 GROUP BY a, b""")
def voted_track_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of each such pair, from all values that its tracks share."""
    tracks = stored(_tracks(spark, sf_dir), "tracks")
    return voted_offsets(stored(voted_candidates(tracks, votes=2), "track-pairs"), tracks)


@query()
def dtw_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warping path between each user's first and second half of values, within a band."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.col("value").alias("v")).alias("step"))
    whole = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("step")), lambda x: x["v"]).alias("v"))
    middle = F.floor(F.size("v") / 2).cast("int")
    halves = whole.select("user_id", F.slice("v", F.lit(1), middle).alias("x"), F.slice("v", middle + 1, F.size("v")).alias("y"))
    pairs = halves.select("user_id", *[resampled(F.col(c), STEPS).alias(c) for c in ("x", "y")])
    return dtw_paths(pairs, "user_id", "x", "y", BAND).select("user_id", "step", "i", "j", F.round("cost", 6).alias("cost"))
