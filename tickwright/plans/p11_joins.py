"""Queries for the join kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickwright.functions.numeric import r6
from tickwright.operators import cluster as cl
from tickwright.operators import dims, joins
from tickwright.operators import neighbors as nn
from tickwright.operators.quality import quality_report
from tickwright.schema import MODEL_WEIGHTS
from tickwright.sources import tables as t

from .p01_files import BAR_SQL, bar_out
from .p02_dims import LOOKUP_SQL, candidates
from .p05_quality import DEF, defects
from .p06_indicators import out
from .p09_forecast import MODELS, model_prices
from .registry import BARS_S, query
from .registry import r6 as q6


@query("left_equi_join", LOOKUP_SQL)
def left_equi_join(spark, d):
    return dims.dim_lookup(candidates(spark, d).select("symbol"), t.dim_supplier(spark, d).drop("category"))


@query("semi_join", f"WITH {DEF} SELECT {BAR_SQL} FROM bars WHERE symbol IN (SELECT symbol FROM verdict WHERE ok)")
def semi_join(spark, d):
    good = quality_report(defects(spark, d)).where("passed").select("symbol")
    return bar_out(t.bars_supplier(spark, d).join(good, "symbol", "left_semi"))


@query("anti_join", f"WITH {DEF} SELECT {BAR_SQL} FROM bars WHERE symbol NOT IN (SELECT symbol FROM verdict WHERE ok)")
def anti_join(spark, d):
    good = quality_report(defects(spark, d)).where("passed").select("symbol")
    return bar_out(t.bars_supplier(spark, d).join(good, "symbol", "left_anti"))


@query("broadcast_constant_join", f"WITH {MODELS} SELECT symbol, horizon, model, {q6('price * w0', 'weighted')} FROM mp")
def broadcast_constant_join(spark, d):
    weights = spark.createDataFrame(list(MODEL_WEIGHTS.items()), "model string, w double")  # nine fixed rows
    m = model_prices(spark, d).join(F.broadcast(weights), "model")
    return out(m.withColumn("weighted", F.col("price") * F.col("w")), ["weighted"], ["symbol", "horizon", "model"])


def customer_points(spark, d):
    """Customers in the plane: balance in hundreds against nation."""
    c = t.table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.array((F.col("c_acctbal") / 100.0), F.col("c_nationkey").cast("double") * 2.0).alias("features"),
    )


POINTS = "pts AS (SELECT c_custkey AS id, c_acctbal / 100.0 AS x, c_nationkey * 2.0::DOUBLE AS y FROM customer)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(
    "range_eps_join",
    f"""WITH {POINTS}, u AS (SELECT x, y, min(id) AS id, count(*) AS copies FROM pts GROUP BY x, y)
SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b, {q6(DIST, 'distance')} FROM u a JOIN u b ON a.id < b.id AND {DIST} <= 1.5""",
)
def range_eps_join(spark, d):
    return cl.eps_join(customer_points(spark, d), 1.5).withColumn("distance", r6("distance"))


def vectors(spark, d):
    e = t.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))


KNN = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label::DOUBLE AS label FROM embeddings),
nb AS (SELECT a.id AS query_id, b.id AS train_id, list_distance(a.f, b.f) AS distance, b.label AS label, a.label AS y,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id)"""


@query("knn_topk_join", f"WITH {KNN} SELECT query_id, rank, train_id, {q6('distance', 'distance')} FROM nb WHERE rank <= 5")
def knn_topk_join(spark, d):
    v = vectors(spark, d)
    near = nn.knn_join(v, v, 5, exclude="id")
    return near.select("query_id", "rank", "train_id", r6("distance").alias("distance"))


@query(
    "asof_join",
    f"""WITH {BARS_S}, s AS (SELECT event_id, ts, user_id, value FROM events), p AS (SELECT user_id, ts AS pts, max(value) AS pv FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
j AS (SELECT s.event_id, s.ts, p.pts, p.pv FROM s ASOF LEFT JOIN p ON s.user_id = p.user_id AND s.ts >= p.pts)
SELECT event_id, CASE WHEN ts < pts + INTERVAL 86400 SECOND THEN floor(pv * 1e6 + 0.5003) / 1e6 END AS last_purchase FROM j""".replace(f"{BARS_S}, ", ""),
)
def asof_join(spark, d):
    q = t.quotes(spark, d)
    bought = q.where(F.col("source") == "purchase").select("symbol", "ts", F.col("price").alias("last_purchase"))
    hits = joins.asof_join(q.select("quote_id", "symbol", "ts"), bought, ["symbol"], "ts", ["last_purchase"], 86400, 3600)
    return hits.select(F.col("quote_id").alias("event_id"), r6("last_purchase").alias("last_purchase"))
