"""Plans of storage tiers and stable numbers of identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.identities import recluster
from quaymark.operators.tiers import Tier, tier_plan
from quaymark.operators.windows import sessions
from quaymark.plans.registry import query, table

#: Fast, middle, slow and slowest; fewer bytes than files ask for on the fast ones.
TIERS = (Tier(500, 1), Tier(150, 2), Tier(60, 3), Tier(10, 4))
_NEED = "bitrate * 1.5 / 8.0"


@query(f"""WITH RECURSIVE f AS (SELECT p_partkey AS key, p_size % 3 = 0 AS video, (1 + p_size * 7 + p_partkey % 13) * 1000000 AS size, 1 + p_partkey % 29 AS seconds,
p_size % 10 / 2.0 AS quality, p_retailprice AS per_pixel, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey * 7 + p_size) % 4 END AS current FROM part),
g AS (SELECT *, size * 8 / seconds / 1e6 AS bitrate FROM f),
h AS (SELECT *, CASE WHEN NOT video THEN -1 WHEN 10 >= {_NEED} THEN 3 WHEN 60 >= {_NEED} THEN 2 WHEN 150 >= {_NEED} THEN 1 ELSE 0 END AS floor FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY -floor, CASE WHEN video THEN bitrate ELSE -quality END, CASE WHEN NOT video THEN per_pixel END NULLS FIRST, key) AS rn FROM h),
b AS (SELECT sum(size) * 1 / 10.0 AS b0, sum(size) * 2 / 10.0 AS b1, sum(size) * 3 / 10.0 AS b2, sum(size) * 4 / 10.0 AS b3 FROM h),
r(rn, u, spot, target) AS (SELECT 0::BIGINT, [0::HUGEINT, 0, 0, 0], 0, 0
  UNION ALL
  SELECT s.rn, list_transform(s.u, lambda x, i: CASE WHEN i = s.t + 1 THEN x + s.size ELSE x END), CASE WHEN s.floor < 0 THEN s.t ELSE s.spot END, s.t
  FROM (SELECT o.rn, o.size, o.floor, r.u, r.spot, CASE WHEN o.floor >= 0 THEN
          CASE WHEN o.floor >= 3 AND r.u[4] + o.size <= b3 THEN 3 WHEN o.floor >= 2 AND r.u[3] + o.size <= b2 THEN 2
               WHEN o.floor >= 1 AND r.u[2] + o.size <= b1 THEN 1 WHEN r.u[1] + o.size <= b0 THEN 0 ELSE o.floor END
        ELSE CASE WHEN r.spot <= 0 AND r.u[1] + o.size <= b0 THEN 0 WHEN r.spot <= 1 AND r.u[2] + o.size <= b1 THEN 1
                  WHEN r.spot <= 2 AND r.u[3] + o.size <= b2 THEN 2 ELSE 3 END END AS t
        FROM r JOIN o ON o.rn = r.rn + 1, b) s),
c AS (SELECT current, sum(size) > 1.1 * CASE current WHEN 0 THEN any_value(b0) WHEN 1 THEN any_value(b1) WHEN 2 THEN any_value(b2) ELSE any_value(b3) END AS over FROM h, b GROUP BY current)
SELECT key AS p_partkey, target, o.current IS NULL OR (o.current <> target AND ((floor >= 0 AND o.current > floor) OR over OR abs(o.current - target) > 1)) AS moves
FROM o JOIN r USING (rn) LEFT JOIN c ON c.current = o.current""")
def storage_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files belong by speed, quality and budget, and which are to be moved."""
    size, seconds = (1 + F.col("p_size") * 7 + F.col("p_partkey") % 13) * 1_000_000, 1 + F.col("p_partkey") % 29
    files = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 == 0, "video").otherwise("image").alias("kind"), size.alias("size"), (size * 8 / seconds / F.lit(1e6)).alias("bitrate"),
        (F.col("p_size") % 10 / 2).alias("quality"), F.col("p_retailprice").alias("per_pixel"),
        F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") * 7 + F.col("p_size")) % 4).alias("current"),
    )
    return tier_plan(files, TIERS).withColumnRenamed("key", "p_partkey")


@query("""WITH g AS (SELECT user_id, event_type, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) <= 172800000000 THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS nth FROM g),
m AS (SELECT event_id AS key, min(event_id) OVER (PARTITION BY event_type, user_id, nth) AS cluster, count(*) OVER (PARTITION BY event_type, user_id, nth) AS n,
  CASE WHEN event_id % 4 = 0 THEN 'name' || (event_id % 3) END AS name, CASE WHEN event_id % 5 > 0 THEN user_id * 2 + event_id % 2 END AS old FROM s),
k AS (SELECT * FROM m WHERE n > 1),
c AS (SELECT cluster, name, count(*) AS n FROM k WHERE name IS NOT NULL GROUP BY 1, 2),
t AS (SELECT cluster, arg_min(name, (-n, name)) AS most FROM c GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT key, cluster, CASE WHEN most IS NOT NULL THEN coalesce(name, most) END AS part, old FROM k LEFT JOIN t USING (cluster)),
v AS (SELECT cluster, part, old, count(*) AS n FROM p WHERE old IS NOT NULL GROUP BY ALL),
z AS (SELECT cluster, part, count(*) AS size, min(key) AS first FROM p GROUP BY ALL),
w AS (SELECT z.*, (SELECT v.old FROM v WHERE v.cluster = z.cluster AND v.part IS NOT DISTINCT FROM z.part ORDER BY v.n DESC, v.old LIMIT 1) AS wish FROM z),
r AS (SELECT *, wish IS NOT NULL AND row_number() OVER (PARTITION BY wish ORDER BY size DESC, first) = 1 AS won FROM w),
x AS (SELECT *, CASE WHEN won THEN wish ELSE (SELECT max(old) + 1 FROM p) + row_number() OVER (PARTITION BY won ORDER BY size DESC, first) - 1 END AS number FROM r)
SELECT m.key AS event_id, coalesce(x.number, -1)::BIGINT AS number FROM m LEFT JOIN p ON p.key = m.key LEFT JOIN x ON x.cluster = p.cluster AND x.part IS NOT DISTINCT FROM p.part""")
def identity_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of like events as proposed clusters, cut by confirmed names, under the numbers that their members had."""
    events = table(spark, sf_dir, "events").withColumn("owner", F.concat_ws("/", "event_type", F.col("user_id").cast("string")))
    placed = sessions(events, "owner", "ts", 172_800, "event_id")
    whole = placed.groupBy("owner", "session").agg(F.min("event_id").alias("cluster"), F.count("*").alias("n"))
    regions = placed.join(whole, ["owner", "session"]).select(
        F.col("event_id").alias("key"), F.when(F.col("n") > 1, F.col("cluster")).alias("cluster"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("name"), (F.col("event_id") % 3).cast("string"))).alias("name"),
        F.when(F.col("event_id") % 5 > 0, F.col("user_id") * 2 + F.col("event_id") % 2).alias("old"),
    )
    return recluster(regions).withColumnRenamed("key", "event_id")
