"""Named queries over the driver's tables, and the SQL that gives the same rows in another engine.

Floats are rounded alike on both sides. Series: events by event_id, days by event type, columns of embeddings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import factor, fill, generate, matrix, metrics, page
from ..sources import series as S
from ..streaming import updates
from . import models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def shared(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/seriesloom-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return S.series(S.table(spark, d, "events"), None, "event_id", "value")


def masked(spark: SparkSession, d: str) -> DataFrame:
    return fill.hide_values(events(spark, d), 0.7)


def daily(spark: SparkSession, d: str, agg: str = "avg") -> DataFrame:
    """Events by type and day; t counts days from the first."""
    e = S.table(spark, d, "events").select("event_type", F.unix_date(F.to_date("ts")).cast("long").alias("day"), "value")
    day = e.groupBy("event_type", "day").agg({"avg": F.avg("value"), "sum": F.sum("value"), "count": F.count("value").cast("double")}[agg].alias("value"))
    first = e.agg(F.min("day").alias("d0"))
    return day.crossJoin(F.broadcast(first)).select(F.col("event_type").alias("series_key"), (F.col("day") - F.col("d0")).cast("long").alias("t"), "value")


def embedding(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as a matrix."""
    e = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return e.select(F.col("vec_id").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def labels_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """A 0/1 matrix: vector i has label j."""
    return S.table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("j"), F.lit(1.0).alias("v"))


LCG = "((({0}) * 1103515245 + 12345) % 2147483648) / 2147483648.0"
EV = "ev AS (SELECT event_id AS t, value AS x FROM events)"
MASK = f"{EV}, mk AS (SELECT t, x AS truth, CASE WHEN {LCG.format('t')} <= 0.7 THEN x END AS x FROM ev)"
#: Vectors have 64 values.
WIDTH = 64
EMB = f"em AS (SELECT vec_id AS i, CAST(u.k - 1 AS BIGINT) AS j, CAST(embedding[u.k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, {WIDTH + 1})) AS k) u)"
LAB = "lb AS (SELECT vec_id AS i, CAST(label AS BIGINT) AS j, 1.0::DOUBLE AS v FROM embeddings)"
DAY = "dd AS (SELECT event_type AS k, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, {0} AS x FROM events GROUP BY 1, 2), dy AS (SELECT k, day - (SELECT min(day) FROM dd) AS t, x FROM dd)"


# --- pages and rows -------------------------------------------------------------------------------------------------


@query("SELECT event_id % 10 AS r, event_id // 10 AS c, value FROM events")
def page_matrix(spark, d):
    return page.page_matrix(events(spark, d), 10).select("r", "c", "value")


@query("SELECT event_id AS t, value FROM events")
def page_roundtrip(spark, d):
    return page.page_series(page.page_matrix(events(spark, d), 10), 10).select("t", "value")


@query("SELECT event_id - (SELECT max(event_id) FROM events) + 399 AS t, value FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 400")
def tail_points(spark, d):
    return page.tail_points(events(spark, d), 400).select("t", "value")


@query("SELECT event_id < 800 AS train, count(*) AS n, min(event_id) AS t0, max(event_id) AS t1 FROM events GROUP BY 1")
def train_test_split(spark, d):
    a, b = page.split_at(events(spark, d), 800)
    both = a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))
    return both.groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


@query("SELECT event_type AS series_key, event_id AS t, CAST(CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS BIGINT) AS block FROM events WHERE event_type IN ('view', 'click')")
def key_subset(spark, d):
    return page.key_blocks(S.series(S.table(spark, d, "events"), "event_type", "event_id", "value"), ["view", "click"]).select("series_key", "t", "block")


@query(f"WITH {DAY.format('avg(value)')} SELECT CAST((CASE k WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) * 5 + t % 5 AS BIGINT) AS row, t // 5 AS c, round(x, 6) + 0.0 AS value FROM dy WHERE k IN ('click', 'view', 'purchase')")
def stacked_pages(spark, d):
    return page.stacked(daily(spark, d), ["click", "view", "purchase"], 5).select("row", "c", r6("value").alias("value"))


@query(f"WITH {DAY.format('avg(value)')} SELECT t, " + ", ".join(f"round(avg(x) FILTER (k = '{k}'), 6) + 0.0 AS {k}" for k in TYPES) + " FROM dy GROUP BY t")
def pivot_mean(spark, d):
    out = S.pivot_mean(daily(spark, d), "t", "series_key", "value", TYPES)
    return out.select("t", *(r6(k).alias(k) for k in TYPES))


@query(f"WITH {DAY.format('avg(value)')} SELECT k AS series_key, t, round(x, 6) + 0.0 AS value FROM dy")
def unpivot_long(spark, d):
    return S.wide_to_long(S.long_to_wide(daily(spark, d), TYPES), "t", TYPES).where("value is not null").select("series_key", "t", r6("value").alias("value"))


@query("SELECT DISTINCT event_type AS series_key FROM events")
def distinct_keys(spark, d):
    return S.table(spark, d, "events").select(F.col("event_type").alias("series_key")).distinct()


@query("SELECT date_trunc('hour', ts) AS ts, CAST(epoch(date_trunc('hour', ts)) // 3600 AS BIGINT) AS t, round(avg(value), 6) + 0.0 AS value FROM events GROUP BY 1, 2")
def grid_regularise(spark, d):
    return S.regular_grid(S.table(spark, d, "events"), "ts", "value").select("ts", "t", r6("value").alias("value"))


# --- filling and scaling --------------------------------------------------------------------------------------------


@query(f"WITH {MASK} SELECT t, round(coalesce(x, (SELECT (min(x) + max(x)) / 2 FROM mk)), 6) + 0.0 AS value FROM mk")
def midrange_fill(spark, d):
    return fill.midrange_fill(masked(spark, d)).select("t", r6("value").alias("value"))


@query(f"WITH {MASK} SELECT t, round(coalesce(x, (min(x) OVER b + max(x) OVER b) / 2, 0), 6) + 0.0 AS value FROM mk WINDOW b AS (PARTITION BY t // 200)")
def batch_fill(spark, d):
    """Every batch of 200 points by its own range."""
    return fill.batch_fill(masked(spark, d), 200).select("t", r6("value").alias("value"))


@query(f"""WITH {MASK}, w AS (SELECT t, x,
  last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, last_value(x IGNORE NULLS) OVER a AS px,
  first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt, first_value(x IGNORE NULLS) OVER b AS nx
  FROM mk WINDOW a AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT t, round(CASE WHEN x IS NOT NULL THEN x WHEN px IS NULL THEN nx WHEN nx IS NULL THEN px ELSE px + (nx - px) * (t - pt) / (nt - pt) END, 6) + 0.0 AS value FROM w""")
def interpolate_linear(spark, d):
    return fill.interpolate(masked(spark, d), 512).select("t", r6("value").alias("value"))


_EXT = "(SELECT min(l_quantity) FROM lineitem)", "(SELECT max(l_quantity) FROM lineitem)"


def _lines(spark, d):
    line = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"))
    return line.crossJoin(F.broadcast(fill.extent(line)))


@query(f"SELECT l_orderkey, l_linenumber, round((l_quantity - ({_EXT[1]} + {_EXT[0]}) / 2) / (({_EXT[1]} - {_EXT[0]}) / 2), 6) + 0.0 AS value FROM lineitem")
def normalize(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(C.normalize(F.col("value"), F.col("high"), F.col("low"))).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) + 0.0 AS value FROM lineitem")
def unnormalize(spark, d):
    high, low = F.col("high"), F.col("low")
    return _lines(spark, d).select("l_orderkey", "l_linenumber", r6(C.unnormalize(C.normalize(F.col("value"), high, low), high, low)).alias("value"))


@query(f"WITH {MASK} SELECT t, x AS value FROM mk")
def hide_values(spark, d):
    return masked(spark, d).select("t", "value")


@query(f"""WITH {EV}, n AS (SELECT max(t) + 1 AS n FROM ev), g AS (SELECT CAST(unnest(range(0, (SELECT (n - 1) // 40 + 1 FROM n))) AS BIGINT) AS g),
p AS (SELECT g, CASE WHEN {LCG.format('g * 40')} > 0.6 THEN g * 40 + CAST(floor({LCG.format('g * 40 + 1')} * 30) AS BIGINT) END AS a FROM g),
q AS (SELECT g, a, least(a + 10, (g + 1) * 40, (SELECT n FROM n)) AS z FROM p),
s AS (SELECT g, a, z, coalesce(sum(coalesce(z - a, 0)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM q)
SELECT t, CASE WHEN s.a IS NOT NULL AND t >= s.a AND t < s.z AND s.done < floor((1 - 0.6) * (SELECT n FROM n)) THEN NULL ELSE x END AS value FROM ev JOIN s ON t // 40 = s.g""")
def hide_runs(spark, d):
    return fill.hide_runs(events(spark, d), 0.6, 10, 40).select("t", "value")


@query(f"WITH {MASK} SELECT count(x) / count(*) AS fraction FROM mk")
def observed_fraction(spark, d):
    return masked(spark, d).agg(metrics.observed_fraction(F.col("value")).alias("fraction"))


@query(f"WITH {MASK}, e AS (SELECT min(x) AS a, max(x) AS b FROM mk) SELECT t, round(least(greatest(truth * 1.5 - 20, a), b), 6) + 0.0 AS value FROM mk, e")
def clip_to_range(spark, d):
    estimate = events(spark, d).withColumn("value", F.col("value") * 1.5 - 20)
    return fill.clip_to_extent(estimate, masked(spark, d)).select("t", r6("value").alias("value"))


@query(f"WITH {MASK} SELECT t, round(coalesce(x, truth * 2), 6) + 0.0 AS value FROM mk")
def fill_from_estimate(spark, d):
    return fill.fill_from(masked(spark, d), events(spark, d).withColumn("value", F.col("value") * 2)).select("t", r6("value").alias("value"))


# --- errors ---------------------------------------------------------------------------------------------------------


@query(f"WITH {MASK} SELECT min(x) AS low, max(x) AS high FROM mk")
def extent(spark, d):
    return fill.extent(masked(spark, d))


@query(f"WITH {DAY.format('avg(value)')} SELECT a.k AS series_key, round(sqrt(avg(power(a.x - b.x, 2))), 6) + 0.0 AS rmse FROM dy a JOIN dy b ON b.k = 'view' AND a.t = b.t GROUP BY 1")
def series_rmse(spark, d):
    day = daily(spark, d)
    view = day.select("series_key", "t").join(day.where("series_key = 'view'").select("t", "value"), "t")
    return metrics.series_rmse(day, view).select("series_key", r6("rmse").alias("rmse"))


@query(f"WITH {MASK} SELECT round(sqrt(avg(power(truth - 10, 2)) FILTER (x IS NULL)), 6) + 0.0 AS rmse FROM mk")
def rmse_hidden(spark, d):
    both = events(spark, d).select("t", F.col("value").alias("truth")).join(masked(spark, d).select("t", "value"), "t")
    return both.agg(r6(metrics.rmse_hidden(F.col("truth"), F.col("value"), F.lit(10.0))).alias("rmse"))


@query(f"WITH {MASK} SELECT round(sum(power(x - 10, 2)) / count(*), 6) + 0.0 AS mse FROM mk")
def masked_mse(spark, d):
    return masked(spark, d).agg(r6(metrics.masked_mse(F.col("value"), F.lit(10.0))).alias("mse"))


@query("WITH r AS (SELECT l_returnflag, l_linestatus, sqrt(avg(power(l_quantity - 25, 2))) AS e FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(avg(e), 6) + 0.0 AS rmse FROM r GROUP BY 1")
def mean_rmse(spark, d):
    e = S.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(metrics.rmse(F.col("l_quantity"), F.lit(25.0)).alias("e"))
    return e.groupBy("l_returnflag").agg(r6(F.avg("e")).alias("rmse"))


@query("WITH w AS (SELECT event_type AS series_key, sum(value) AS w FROM events GROUP BY 1) SELECT series_key, round(w / (SELECT sum(w) FROM w), 6) + 0.0 AS w FROM w")
def weight_share(spark, d):
    w = S.table(spark, d, "events").groupBy(F.col("event_type").alias("series_key")).agg(F.sum("value").alias("w"))
    return metrics.shares(w, "w").select("series_key", r6("w").alias("w"))


# --- generators -----------------------------------------------------------------------------------------------------


@query("SELECT i AS t, round(CASE WHEN i >= 20 THEN -2 * sin(i * 26 * 2 * pi() / 2000) + 3 * sin(i * 30 * 2 * pi() / 2000) - 2.5 * cos(i * 16 * 2 * pi() / 2000) ELSE 0 END, 6) + 0.0 AS value FROM range(2000) g(i)")
def harmonics(spark, d):
    return generate.harmonics(spark, [-2, 3], [26, 30], [-2.5], [16], 2000, 20).select("t", r6("value").alias("value"))


@query("SELECT event_id AS t, TIMESTAMP '2017-09-02 00:00:00' + event_id * INTERVAL 1 MINUTE AS ts, value FROM events")
def minute_index(spark, d):
    """A series by the minute, as generated ones are."""
    return S.date_index(events(spark, d), "2017-09-02 00:00:00").select("t", "ts", "value")


@query(f"WITH {DAY.format('avg(value)')} SELECT k AS series_key, t, round(x, 6) + 0.0 AS value FROM dy WHERE k <> 'error'")
def drop_label(spark, d):
    return S.drop_keys(daily(spark, d), ["error"]).select("series_key", "t", r6("value").alias("value"))


@query("SELECT i AS t, round(power(i, 0.35) - 2.5, 6) + 0.0 AS value FROM range(5, 1000) g(i)")
def trend_linear(spark, d):
    return generate.generated(spark, C.linear_trend, 1000, 5, power=0.35, displacement=-2.5).select("t", r6("value").alias("value"))


@query("SELECT i AS t, round(ln(i + 1) + 1.5, 6) + 0.0 AS value FROM range(1000) g(i)")
def trend_log(spark, d):
    return generate.generated(spark, C.log_trend, 1000, displacement=1.5).select("t", r6("value").alias("value"))


@query("SELECT i AS t, round(exp(-i * 0.01) + 0.5, 6) + 0.0 AS value FROM range(1000) g(i)")
def trend_exp(spark, d):
    return generate.generated(spark, C.exp_trend, 1000, dampening=0.01, displacement=0.5).select("t", r6("value").alias("value"))


@query(f"""WITH RECURSIVE e AS (SELECT i AS t, {LCG.format('i')} - 0.5 AS e FROM range(300) g(i)),
x AS (SELECT CAST(0 AS BIGINT) AS t, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS mean
  UNION ALL SELECT x.t + 1, CASE WHEN x.t + 1 < 2 OR x.t + 1 >= 298 THEN 0.0 ELSE 0.3 * x.x0 + 0.2 * x.x1 + 0.5 * a.e + 0.1 * b.e + a.e END, x.x0, x.x1,
    CASE WHEN x.t + 1 < 2 OR x.t + 1 >= 298 THEN 0.0 ELSE 0.3 * x.x0 + 0.2 * x.x1 + 0.5 * a.e + 0.1 * b.e END
  FROM x JOIN e a ON a.t = x.t + 1 JOIN e b ON b.t = x.t)
SELECT t, round(x0, 6) + 0.0 AS observation, round(mean, 6) + 0.0 AS mean FROM x""")
def arma(spark, d):
    noise = generate.generated(spark, lambda t: C.lcg(t) - 0.5, 300)
    return generate.arma(noise, [0.4, 0.3, 0.2], [0.5, 0.1]).select("t", r6("observation").alias("observation"), r6("mean").alias("mean"))


@query(f"WITH f AS (SELECT r.i, c.j, {LCG.format('r.i + 1')} AS a, {LCG.format('c.j + 100001')} AS b FROM range(40) r(i), range(30) c(j)) SELECT i, j, round(10 / (1 + exp(-(a + b + a * b))), 6) + 0.0 AS v FROM f")
def low_rank_matrix(spark, d):
    return generate.logistic_matrix(spark, 40, 30).select("i", "j", r6("v").alias("v"))


@query(f"WITH f AS (SELECT r.i, c.j, {LCG.format('r.i + 1')} AS a, {LCG.format('c.j + 100001')} AS b FROM range(40) r(i), range(30) c(j)), m AS (SELECT i, j, 10 / (1 + exp(-(a + b + a * b))) AS v FROM f) SELECT CAST(-1 AS BIGINT) AS i, j, round(sum(CASE i WHEN 3 THEN 0.25 WHEN 7 THEN 0.75 END * v), 6) + 0.0 AS v FROM m WHERE i IN (3, 7) GROUP BY j")
def convex_target(spark, d):
    return generate.convex_row(generate.logistic_matrix(spark, 40, 30), {3: 1.0, 7: 3.0}).select("i", "j", r6("v").alias("v"))


# --- matrices -------------------------------------------------------------------------------------------------------


@query(f"WITH {EMB} SELECT i, j, round(v * 2, 6) + 0.0 AS v FROM em")
def mat_add(spark, d):
    m = embedding(spark, d)
    return matrix.add(m, m).select("i", "j", r6("v").alias("v"))


@query(f"WITH {EMB}, {LAB} SELECT coalesce(em.i, lb.i) AS i, coalesce(em.j, lb.j) AS j, round(coalesce(em.v, 0) - coalesce(lb.v, 0), 6) + 0.0 AS v FROM em FULL JOIN lb ON em.i = lb.i AND em.j = lb.j")
def mat_subtract(spark, d):
    return matrix.subtract(embedding(spark, d), labels_by_vector(spark, d)).select("i", "j", r6("v").alias("v"))


@query(f"WITH {EMB} SELECT j AS i, i AS j, v FROM em")
def mat_transpose(spark, d):
    return matrix.transpose(embedding(spark, d))


@query(f"WITH {EMB} SELECT a.i, b.i AS j, round(0.5 * sum(a.v * b.v), 6) + 0.0 AS v FROM em a JOIN em b ON a.j = b.j GROUP BY 1, 2")
def mat_dot(spark, d):
    m = embedding(spark, d)
    return matrix.dot(m, matrix.transpose(m), 0.5, inner=WIDTH, digits=6)


@query(f"WITH {EMB}, {LAB} SELECT em.j AS i, lb.j, round(sum(em.v * lb.v), 5) + 0.0 AS v FROM em JOIN lb ON em.i = lb.i GROUP BY 1, 2")
def mat_dot_at(spark, d):
    return matrix.dot(embedding(spark, d), labels_by_vector(spark, d), a_transpose=True).select("i", "j", r6("v", 5).alias("v"))


@query(f"WITH {EMB} SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM em a JOIN em b ON a.j = b.j GROUP BY 1, 2")
def mat_dot_bt(spark, d):
    m = embedding(spark, d)
    return matrix.dot(m, m, b_transpose=True, inner=WIDTH, digits=6)


@query(f"WITH {EMB}, g AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM em a JOIN em b ON a.i = b.i GROUP BY 1, 2) SELECT g.i, em.i AS j, round(sum(g.v * em.v), 4) + 0.0 AS v FROM g JOIN em ON g.j = em.j GROUP BY 1, 2")
def mat_dot_atbt(spark, d):
    m = embedding(spark, d)
    g = matrix.dot(m, m, a_transpose=True)
    return matrix.dot(g, m, a_transpose=True, b_transpose=True).select("i", "j", r6("v", 4).alias("v"))


@query(f"WITH {EMB} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS g FROM em a JOIN em b ON a.i = b.i GROUP BY 1, 2")
def gram_rows(spark, d):
    cells = embedding(spark, d).select(F.col("j").alias("row"), F.col("i").alias("c"), F.col("v").alias("value"))
    return factor.gram_rows(cells).select("i", "j", r6("g", 5).alias("g"))


@query(f"WITH {EMB} SELECT a.j AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS g FROM em a JOIN em b ON a.i = b.i GROUP BY 1, 2")
def gram_blocks(spark, d):
    cells = embedding(spark, d).select(F.col("j").alias("row"), F.col("i").alias("c"), F.col("v").alias("value"))
    g = factor.gram(factor.columns(cells, WIDTH), WIDTH)
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(WIDTH) for j in range(WIDTH)], "i long, j long, g double").select("i", "j", r6("g", 5).alias("g"))


@query(f"WITH {EMB} SELECT i, j, v FROM em")
def matrix_write_read_copy(spark, d):
    at = shared(spark)
    S.write_matrix(embedding(spark, d), at, "a")
    S.copy_matrix(spark, at, "a", at, "b")
    return S.read_matrix(spark, at, "b")


@query("SELECT CAST(20 AS BIGINT) AS i, CAST(600 AS BIGINT) AS cells, true AS centred")
def random_matrix(spark, d):
    m = S.random_matrix(spark, 20, 30, 5.0, 2.0, seed=7, segments=4)
    return m.agg(F.countDistinct("i").alias("i"), F.count(F.lit(1)).alias("cells"), (F.abs(F.avg("v") - 5) < 0.5).alias("centred"))


@query("SELECT l_returnflag AS series_key, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def csv_scan(spark, d):
    at = shared(spark)
    S.table(spark, d, "lineitem").select("l_returnflag", "l_quantity").write.option("header", True).csv(at)
    return S.read_csv(spark, at, "l_returnflag string, l_quantity double").groupBy(F.col("l_returnflag").alias("series_key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


# --- models ---------------------------------------------------------------------------------------------------------

#: A page matrix of two rows has a closed form: the largest eigenpair of a symmetric 2 x 2 matrix.
_TWO = f"""{EV}, a AS (SELECT t // 2 AS c, max(x) FILTER (t % 2 = 0) AS x0, max(x) FILTER (t % 2 = 1) AS x1 FROM ev GROUP BY 1),
g AS (SELECT sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11 FROM a),
l AS (SELECT *, (g00 + g11) / 2 + sqrt(power((g00 - g11) / 2, 2) + g01 * g01) AS lam, (g00 + g11) / 2 - sqrt(power((g00 - g11) / 2, 2) + g01 * g01) AS mu FROM g),
u AS (SELECT *, g01 / sqrt(g01 * g01 + power(lam - g00, 2)) AS u0, (lam - g00) / sqrt(g01 * g01 + power(lam - g00, 2)) AS u1 FROM l)"""


def _length(series: DataFrame) -> int:
    return series.agg(F.max("t")).first()[0] + 1


def _two(spark, d, **options):
    e = events(spark, d)
    m = e.agg(F.max("t")).first()[0] // 2 + 1
    return models.fit_svd(e, "x", n=2, m=m, k=1, check=False, **options)


@query(f"WITH {_TWO} SELECT c * 2 + q AS t, round(CASE q WHEN 0 THEN u0 * (u0 * x0 + u1 * x1) ELSE u1 * (u0 * x0 + u1 * x1) END / 0.8, 6) + 0.0 AS value FROM a, u, (SELECT unnest([0, 1]) AS q)")
def svd_denoise(spark, d):
    return _two(spark, d, p=0.8).denoised().select("t", r6("value").alias("value"))


@query(f"WITH {_TWO} SELECT c * 2 + q AS t, round(CASE q WHEN 0 THEN u0 * (u0 * x0 + u1 * x1) ELSE u1 * (u0 * x0 + u1 * x1) END, 6) + 0.0 AS value FROM a, u, (SELECT unnest([0, 1]) AS q) WHERE c * 2 + q >= (SELECT count(*) // 4 FROM ev) AND c * 2 + q < (SELECT count(*) // 2 FROM ev)")
def denoised_range(spark, d):
    """De-noised values of the second quarter of the fitted points."""
    n = _length(events(spark, d))
    return _two(spark, d).denoised(n // 4, n // 2).select("t", r6("value").alias("value"))


@query(f"WITH {_TWO} SELECT CAST(0 AS BIGINT) AS k, round(sqrt(lam), 4) + 0.0 AS s FROM l UNION ALL SELECT 1, round(sqrt(mu), 4) + 0.0 FROM l")
def svd_singular_values(spark, d):
    cells = page.page_matrix(events(spark, d), 2).select(F.col("r").alias("row"), "c", "value")
    s, _ = factor.eigen(factor.gram(factor.columns(cells, 2), 2), 2)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "k long, s double").select("k", r6("s", 4).alias("s"))


@query(f"WITH {_TWO} SELECT c, round(1e6 * 0.8 * (g11 * x0 - g01 * x1) / (g00 * g11 - g01 * g01), 4) + 0.0 AS y0, round(1e6 * 0.8 * (g00 * x1 - g01 * x0) / (g00 * g11 - g01 * g01), 4) + 0.0 AS y1 FROM a, g")
def pseudo_inverse(spark, d):
    """Of full rank, in millionths."""
    cells = page.page_matrix(events(spark, d), 2).select(F.col("r").alias("row"), "c", "value")
    out = factor.pseudo_inverse(factor.columns(cells, 2), 2, 2, 0.8)
    return out.select("c", r6(F.col("y")[0] * 1e6, 4).alias("y0"), r6(F.col("y")[1] * 1e6, 4).alias("y1"))


@query(f"WITH {_TWO}, b AS (SELECT u0 * (u0 * x0 + u1 * x1) / 0.8 AS b, x1 AS l FROM a, u) SELECT CAST(0 AS INTEGER) AS lag_row, round(0.8 * sum(b * l) / sum(b * b), 6) + 0.0 AS w FROM b")
def svd_weights(spark, d):
    return _two(spark, d, p=0.8).weight_table().select("lag_row", r6("w").alias("w"))


@query(f"WITH {_TWO}, b AS (SELECT u0 * (u0 * x0 + u1 * x1) AS b, x1 AS l FROM a, u), w AS (SELECT sum(b * l) / sum(b * b) AS w FROM b) SELECT t, x AS actual, round(w * lag(x) OVER (ORDER BY t), 6) + 0.0 AS forecast FROM ev, w QUALIFY t > 0")
def rolling_forecast(spark, d):
    return _two(spark, d).forecast(events(spark, d), 1000).select("t", "actual", r6("forecast").alias("forecast"))


def _pair_sql(where: str, x: str = "x") -> str:
    """Least squares of purchase on click and view, over the days that `where` takes."""
    return f"""a AS (SELECT t, max({x}) FILTER (k = 'click') AS c, max({x}) FILTER (k = 'view') AS v, max({x}) FILTER (k = 'purchase') AS y FROM dy GROUP BY 1),
s AS (SELECT sum(c * c) AS cc, sum(c * v) AS cv, sum(v * v) AS vv, sum(c * y) AS cy, sum(v * y) AS vy FROM a WHERE {where}),
w AS (SELECT (cy * vv - vy * cv) / (cc * vv - cv * cv) AS wc, (vy * cc - cy * cv) / (cc * vv - cv * cv) AS wv FROM s)"""


def _control(spark, d, method="svd"):
    return models.SyntheticControl.fit(daily(spark, d).where("t < 20"), "purchase", ["click", "view"], m=20, k=3, method=method)


@query(f"WITH {DAY.format('avg(value)')}, {_pair_sql('t < 20')} SELECT 'click' AS series_key, round(wc, 6) + 0.0 AS w FROM w UNION ALL SELECT 'view', round(wv, 6) + 0.0 FROM w")
def control_weights(spark, d):
    return _control(spark, d).weights().select("series_key", r6("w").alias("w"))


@query(f"WITH {DAY.format('avg(value)')}, {_pair_sql('t < 20')} SELECT t, round(wc * c + wv * v, 6) + 0.0 AS prediction FROM a, w")
def control_predict(spark, d):
    return _control(spark, d).predict(daily(spark, d)).select("t", r6("prediction").alias("prediction"))


@query(f"""WITH {DAY.format('avg(value)')}, {DAY.format('count(value)::DOUBLE').replace('dd', 'd2').replace('dy', 'y2')},
b AS (SELECT 0 AS metric, k, t, x * sqrt(2.0) AS x FROM dy UNION ALL SELECT 1, k, t, x * sqrt(0.5) FROM y2),
a AS (SELECT metric, t, max(x) FILTER (k = 'click') AS c, max(x) FILTER (k = 'view') AS v, max(x) FILTER (k = 'purchase') AS y FROM b GROUP BY 1, 2),
s AS (SELECT sum(c * c) AS cc, sum(c * v) AS cv, sum(v * v) AS vv, sum(c * y) AS cy, sum(v * y) AS vy FROM a WHERE t < 20),
w AS (SELECT (cy * vv - vy * cv) / (cc * vv - cv * cv) AS wc, (vy * cc - cy * cv) / (cc * vv - cv * cv) AS wv FROM s)
SELECT CAST(metric AS INTEGER) AS metric, t, round(wc * c + wv * v, 5) + 0.0 AS prediction FROM a, w""")
def multi_metric_predict(spark, d):
    both = [daily(spark, d), daily(spark, d, "count")]
    m = models.MultiMetricControl.fit([x.where("t < 20") for x in both], [2.0, 0.5], "purchase", ["click", "view"], m=20, k=3)
    return m.predict(both).select("metric", "t", r6("prediction", 5).alias("prediction"))


@query(f"""WITH {DAY.format('avg(value)')}, {_pair_sql('t < 24')}
SELECT t, y AS actual, round(wc * c + wv * v, 6) + 0.0 AS forecast FROM a, w""".replace("y AS actual", "round(y, 6) + 0.0 AS actual"))
def rolling_forecast_multi(spark, d):
    """One row a series and no past: others at the same time give the target, for all times at once."""
    m = models.fit_svd(daily(spark, d).where("t < 24"), "purchase", ["click", "view"], n=1, m=24, k=3, past_only=False)
    return m.forecast(daily(spark, d)).select("t", r6("actual").alias("actual"), r6("forecast").alias("forecast"))


_ALS = f"{MASK}, a AS (SELECT t % 4 AS r, t // 4 AS c, x FROM mk WHERE x IS NOT NULL), v0 AS (SELECT DISTINCT c, 1.0::DOUBLE AS v FROM a)" + "".join(
    f", u{i} AS (SELECT r, sum(v * x) / sum(v * v) AS u FROM a JOIN v{i - 1} USING (c) GROUP BY r), v{i} AS (SELECT c, sum(u * x) / sum(u * u) AS v FROM a JOIN u{i} USING (r) GROUP BY c)" for i in (1, 2, 3)
)


@query(f"WITH {_ALS} SELECT r AS row, c, round(u * v, 5) + 0.0 AS value FROM u3, v3")
def als_rank_one(spark, d):
    """Three rounds from a right factor of ones."""
    cells = page.page_matrix(masked(spark, d), 4).select(F.col("r").alias("row"), "c", "value")
    ones = cells.select(F.col("c").cast("long").alias("c")).distinct().select("c", F.array(F.lit(1.0)).alias("f"))
    u, v, _, _ = factor.als(cells, 1, 0.0, 3, -1.0, start=ones)
    return factor.reconstruct(u, v).select("row", "c", r6("value", 5).alias("value"))


_N, _HEAD = "(SELECT (max(event_id) + 1) // 2 * 2 FROM events)", "(SELECT (max(event_id) + 1) * 7 // 20 * 2 FROM events)"


def _initial(spark, d, n, k):
    """The whole columns of all events, and the state after the first 70 % of them, by a Gram matrix on the executors."""
    e = events(spark, d)
    total = _length(e)
    cut, stop = total * 7 // (10 * n) * n, total // n * n
    head = page.page_matrix(fill.midrange_fill(e.where(F.col("t") < cut)), n).select(F.col("r").alias("row"), "c", "value")
    return e.where(F.col("t") < stop), cut, updates.start_gram(factor.gram(factor.columns(head, n), n), cut, k)


@query(f"WITH {_TWO.replace('FROM events', f'FROM events WHERE event_id < {_HEAD}')}, n AS (SELECT event_id // 2 AS c, max(value) FILTER (event_id % 2 = 0) AS y0, max(value) FILTER (event_id % 2 = 1) AS y1 FROM events WHERE event_id >= {_HEAD} AND event_id < {_N} GROUP BY 1) SELECT c * 2 + q AS t, round(CASE q WHEN 0 THEN u0 ELSE u1 END * (u0 * y0 + u1 * y1), 6) + 0.0 AS value FROM n, u, (SELECT unnest([0, 1]) AS q)")
def fold_in(spark, d):
    """The last 30 % of the columns against the vectors of the first 70 %, which folding-in leaves as they are: one pass."""
    e, cut, state = _initial(spark, d, 2, 1)
    new = page.page_matrix(e.where(F.col("t") >= cut), 2).select(F.col("r").alias("row"), "c", "value")
    out = factor.project(factor.columns(new, 2), state.u @ state.u.T).select("c", F.posexplode("y").alias("r", "value"))
    return out.select((F.col("c") * 2 + F.col("r")).cast("long").alias("t"), r6("value").alias("value"))


#: Columns that come to the driver as one row.
_TURN = 1 << 14


def _in_turn(cols: DataFrame):
    """Rows (b, x) in the order of the columns: the points of up to _TURN columns one after another; NULL where one has a gap."""
    runs = cols.groupBy(F.floor(F.col("c") / _TURN).alias("b")).agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("x"))
    return runs.select("b", F.flatten(F.transform("x", lambda v: v["x"])).alias("x")).orderBy("b").toLocalIterator()


@query(f"""WITH RECURSIVE {_TWO.replace('FROM events', f'FROM events WHERE event_id < {_HEAD}')}, n AS (SELECT event_id // 2 AS c, max(value) FILTER (event_id % 2 = 0) AS y0, max(value) FILTER (event_id % 2 = 1) AS y1 FROM events WHERE event_id >= {_HEAD} AND event_id < {_N} GROUP BY 1),
st AS (SELECT {_HEAD} // 2 AS c, lam, u0, u1 FROM u UNION ALL
  SELECT c + 1, mu, h01 / sqrt(h01 * h01 + power(mu - h00, 2)), (mu - h00) / sqrt(h01 * h01 + power(mu - h00, 2)) FROM (
    SELECT c, h00, h01, (h00 + h11) / 2 + sqrt(power((h00 - h11) / 2, 2) + h01 * h01) AS mu FROM (
      SELECT st.c, lam * u0 * u0 + y0 * y0 AS h00, lam * u0 * u1 + y0 * y1 AS h01, lam * u1 * u1 + y1 * y1 AS h11 FROM st JOIN n ON n.c = st.c)))
SELECT CAST(2 * c AS BIGINT) AS points, round(sqrt(lam), 4) + 0.0 AS s FROM st ORDER BY c DESC LIMIT 1""")
def rank_k_update(spark, d):
    """The singular value after each of the last 30 % of the columns in turn, kept to rank one."""
    e, cut, state = _initial(spark, d, 2, 1)
    later = factor.columns(page.page_matrix(e.where(F.col("t") >= cut), 2).select(F.col("r").alias("row"), "c", "value"), 2)
    for r in _in_turn(later):
        if r.x is None:
            raise ValueError(f"a column from {r.b * _TURN} on does not have 2 points")
        state = updates.update_each(state, np.array(r.x, float).reshape(-1, 2))
    return spark.createDataFrame([(state.points, float(state.s[0]))], "points long, s double").select("points", r6("s", 4).alias("s"))


@query()
def svd_multi_series(spark, d):
    m = models.fit_svd(daily(spark, d), "purchase", ["click", "view", "signup"], n=5, m=6, k=3, check=False)
    return m.denoised()


@query()
def svd_page_50(spark, d):
    """All whole columns of 20 points that the series has."""
    e = masked(spark, d)
    return models.fit_svd(e, "x", n=20, m=_length(e) // 20, k=5, p=0.7).denoised()


@query()
def als_forecaster(spark, d):
    """All whole columns of two days that the series have."""
    e = fill.hide_values(daily(spark, d), 0.8, lambda t: C.lcg(t + 7))
    return models.fit_als(e, "purchase", ["click"], n=2, m=_length(e) // 2, k=2, iterations=4, check=False).denoised()


@query()
def control_als(spark, d):
    """Synthetic control by ALS, and with several metrics, of daily means with hidden values."""
    day = fill.hide_values(daily(spark, d), 0.9, lambda t: C.lcg(t + 11))
    m = _length(day)
    one = models.SyntheticControl.fit(day, "purchase", ["click", "view", "signup", "error"], m=m, k=2, method="als", iterations=6, check=False)
    both = models.MultiMetricControl.fit([day, daily(spark, d, "count")], [2.0, 0.5], "purchase", ["click", "view"], m=m, k=2, method="als", iterations=6, check=False)
    return one.predict(daily(spark, d)).select(F.lit(-1).alias("metric"), "t", "prediction").unionByName(both.predict([daily(spark, d), daily(spark, d, "count")]))


@query()
def segmented_forecaster(spark, d):
    e = events(spark, d)
    return models.Segmented.fit(e, "x", _length(e), rows=10, k=2, rect=4).denoised()


@query("""WITH ev AS (SELECT event_id AS t, value AS x, event_id // 100 AS b FROM events WHERE event_id < (SELECT (max(event_id) + 1) // 100 * 100 FROM events)),
a AS (SELECT b, t // 2 AS c, max(x) FILTER (t % 2 = 0) AS x0, max(x) FILTER (t % 2 = 1) AS x1 FROM ev GROUP BY 1, 2),
g AS (SELECT b, sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11 FROM a GROUP BY 1),
l AS (SELECT *, (g00 + g11) / 2 + sqrt(power((g00 - g11) / 2, 2) + g01 * g01) AS lam FROM g),
u AS (SELECT b, g01 / sqrt(g01 * g01 + power(lam - g00, 2)) AS u0, (lam - g00) / sqrt(g01 * g01 + power(lam - g00, 2)) AS u1 FROM l)
SELECT c * 2 + q AS t, round(CASE q WHEN 0 THEN u0 * (u0 * x0 + u1 * x1) ELSE u1 * (u0 * x0 + u1 * x1) END, 6) + 0.0 AS value FROM a JOIN u USING (b), (SELECT unnest([0, 1]) AS q)""")
def segmented_update(spark, d):
    """Sub-models of 100 points over the first 70 % of the events, then over all of them; the earlier ones stay."""
    e = events(spark, d)
    n = _length(e)
    seg = models.Segmented.begin("x", rows=2, k=1, rect=25, gamma=1.0).update(e.where(F.col("t") < n * 7 // 10), n * 7 // 10)
    return seg.update(e, n).denoised().select("t", r6("value").alias("value"))


#: Points of a file of the stream, and of a write of its results.
_FILE, _FLUSH = 1 << 20, 1 << 16


@query()
def stream_updates(spark, d):
    """The last 30 % of the points arrive as files; each whole column updates the model of the first 70 %."""
    at = shared(spark)
    e, cut, state = _initial(spark, d, 10, 3)
    stop = _length(e)
    for a in range(cut, stop, _FILE):  # one after the other: the stream takes files by their age
        e.where((F.col("t") >= a) & (F.col("t") < min(a + _FILE, stop))).coalesce(1).write.mode("append").parquet(f"{at}/in")
    schema, rows = "series_key string, t long, value double", []

    def flush() -> None:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{at}/out")
        rows.clear()

    def sink(k, t, s, x) -> None:
        rows.extend((k, t + i, float(v)) for i, v in enumerate(x))
        if len(rows) >= _FLUSH:
            flush()

    q = updates.run_updates(updates.series_stream(spark, f"{at}/in", 1), {"x": state}, sink, f"{at}/log", "UP")
    q.processAllAvailable()
    q.stop()
    flush()
    return spark.read.schema(schema).parquet(f"{at}/out")
