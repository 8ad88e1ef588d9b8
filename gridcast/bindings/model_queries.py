"""Models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import TRAIN_FEATURES, eliminate, query, sql
from gridcast.functions.calendar import dow_number
from gridcast.models import evaluate, linear, response, trees
from gridcast.models.dispatch import ModelRegistry
from gridcast.operators.windows import lag_features
from gridcast.session import materialize, scratch_path
from gridcast.sources import model_store, moment_store

# ------------------------------------------------------------------ SQL parts


def _covariances(source: str, features: list[str], where: str = "true") -> str:
    p = len(features)
    cells = [f"covar_pop({features[i]}, {features[j]}) AS m_{i}_{j}" for i, j in product(range(p), range(p))]
    cells += [f"covar_pop({x}, mw) AS m_{i}_{p}" for i, x in enumerate(features)]
    means = [f"avg({x}) AS mean_{i}" for i, x in enumerate(features)]
    return f"SELECT zone, count(*) AS n, {', '.join(means)}, avg(mw) AS mean_y, {', '.join(cells)} FROM {source} WHERE {where} GROUP BY zone"


def _linear_views(source: str, features: list[str], where: str = "true") -> dict[str, str]:
    """Views up to ``models``: zone, n, b_0.., intercept."""
    p = len(features)
    keys = ["zone", "n", "mean_y", *[f"mean_{i}" for i in range(p)]]
    betas = ", ".join(f"m_{i}_{p} AS b_{i}" for i in range(p))
    intercept = "mean_y - (" + " + ".join(f"m_{i}_{p} * mean_{i}" for i in range(p)) + ")"
    return {
        "sums": _covariances(source, features, where),
        **eliminate("sums", keys, p, p + 1),
        "models": f"SELECT zone, n, {betas}, {intercept} AS intercept FROM step{p - 1}",
    }


def _coefficient_rows(features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT zone, n, '{x}' AS feature, round(b_{i}, 4) AS coefficient, round(intercept, 4) AS intercept FROM models"
        for i, x in enumerate(features))


def _prediction(features: list[str], row: str = "t") -> str:
    return "m.intercept + " + " + ".join(f"{row}.{x} * m.b_{i}" for i, x in enumerate(features))


_FIT = _linear_views("train", TRAIN_FEATURES, "test = 0")
_SCORED = {**_FIT, "scored": f"""
    SELECT t.*, {_prediction(TRAIN_FEATURES)} AS prediction FROM train t LEFT JOIN models m ON t.zone = m.zone WHERE t.test = 1"""}

# ---------------------------------------------------------------- Spark parts


def _explode_models(models):
    pairs = F.arrays_zip(F.col("features").alias("feature"), F.col("coefficients").alias("coefficient"))
    rows = models.select("zone", "n", "intercept", F.inline(pairs))
    return c.rounded(rows, 4, "coefficient", "intercept")


def _stored_models(spark, d):
    path = scratch_path(spark, "models")
    model_store.save_linear(linear.fit(c.train(spark, d).filter("test = 0"), TRAIN_FEATURES), path)
    return model_store.load_linear(spark, path)


def _scored(spark, d):
    test = c.train(spark, d).filter("test = 1")
    return linear.predict(test, _stored_models(spark, d), TRAIN_FEATURES)


@query("model_store", sql(_coefficient_rows(TRAIN_FEATURES), "train", extra=_FIT))
def stored(spark, d):
    return _explode_models(_stored_models(spark, d))


@query("per_zone_linear_fit", sql(_coefficient_rows(TRAIN_FEATURES), "train", extra=_FIT))
def per_zone_linear_fit(spark, d):
    return _explode_models(linear.fit(c.train(spark, d).filter("test = 0"), TRAIN_FEATURES))


_LAG_FEATURES = ["hour", "temp", "previous_temp", "previous_mw"]
_LAGGED = {"lagged": """
    SELECT * FROM (SELECT zone, ds, hour, mw, temp, lag(mw, 48) OVER w AS previous_mw, lag(temp, 24) OVER w AS previous_temp
    FROM load_hourly WINDOW w AS (PARTITION BY zone ORDER BY ds)) WHERE previous_mw IS NOT NULL"""}


@query("per_zone_lag_fit", sql(_coefficient_rows(_LAG_FEATURES), "load_hourly", extra={**_LAGGED, **_linear_views("lagged", _LAG_FEATURES)}))
def per_zone_lag_fit(spark, d):
    return _explode_models(linear.fit(lag_features(c.stored_hourly(spark, d)), _LAG_FEATURES))


# The reference's own widths: eight features with two flags, ten with the lags. The month does not vary in these tables; the weekday does.
_WIDE_FEATURES = ["dow_num", "temp", "precip", "rh", "pressure", "windspeed", "rain", "snow"]
_WIDE = {"wide": """
    SELECT l.zone, l.ds, l.date, isodow(l.ds) AS dow_num, w.temp, w.precip, w.rh, w.pressure, w.windspeed, CAST(w.rain AS INTEGER) AS rain,
           CAST(w.snow AS INTEGER) AS snow, l.mw FROM load_hourly l JOIN weather w ON l.zone = w.zone AND l.ds = w.datetime"""}
_WIDE_LAG_FEATURES = [*_WIDE_FEATURES, "previous_temp", "previous_mw"]
_WIDE_LAGGED = {**_WIDE, "wide_lagged": """
    SELECT * FROM (SELECT *, lag(mw, 48) OVER w AS previous_mw, lag(temp, 24) OVER w AS previous_temp
    FROM wide WINDOW w AS (PARTITION BY zone ORDER BY ds)) WHERE previous_mw IS NOT NULL"""}


def _wide(spark, d):
    weather = c.weather(spark, d).withColumnRenamed("datetime", "ds")
    rows = c.load_hourly(spark, d).select("zone", "ds", "date", "mw").join(weather, ["zone", "ds"])
    return materialize(rows.withColumn("dow_num", dow_number(F.col("date"))), "wide")


@query("per_zone_linear_fit_wide", sql(_coefficient_rows(_WIDE_FEATURES), "load_hourly", "weather", extra={**_WIDE, **_linear_views("wide", _WIDE_FEATURES)}))
def per_zone_linear_fit_wide(spark, d):
    """Least squares on eight features, two of them flags."""
    return _explode_models(linear.fit(_wide(spark, d), _WIDE_FEATURES))


@query("per_zone_lag_fit_wide", sql(_coefficient_rows(_WIDE_LAG_FEATURES), "load_hourly", "weather", extra={
    **_WIDE_LAGGED, **_linear_views("wide_lagged", _WIDE_LAG_FEATURES)}))
def per_zone_lag_fit_wide(spark, d):
    """The same with the load of two days and the temperature of one day before: ten features."""
    return _explode_models(linear.fit(lag_features(_wide(spark, d)), _WIDE_LAG_FEATURES))


@query("per_zone_fit_by_days", sql(_coefficient_rows(_WIDE_FEATURES), "load_hourly", "weather", extra={**_WIDE, **_linear_views("wide", _WIDE_FEATURES)}))
def per_zone_fit_by_days(spark, d):
    """Least squares from moments stored per day; the second half of the days comes after the first."""
    rows, path = _wide(spark, d), scratch_path(spark, "moments")
    late = F.dayofmonth("date") > 15
    for part in (rows.filter(~late), rows.filter(late)):
        moment_store.write_days(part, path, _WIDE_FEATURES)
    return _explode_models(moment_store.fit_days(spark, path, _WIDE_FEATURES))


_LAG_SPLIT = {**_LAGGED, **_linear_views("lagged", _LAG_FEATURES, "ds < TIMESTAMP '2024-01-24'"), "scored": f"""
    SELECT t.*, {_prediction(_LAG_FEATURES)} AS prediction FROM lagged t LEFT JOIN models m ON t.zone = m.zone WHERE t.ds >= TIMESTAMP '2024-01-24'"""}


@query("per_zone_lag_mape", sql("""
    SELECT zone, round(avg(abs((mw - prediction) / nullif(mw, 0))), 6) AS mape, round(avg(abs((mw - prediction) / nullif(mw, 0))) * 100, 4) AS mape_pct,
           count(*) FILTER (mw = 0) AS skipped, count(*) FILTER (mw IS NOT NULL AND prediction IS NULL) AS unscored,
           round(avg(abs(mw - prediction)), 4) AS mae FROM scored GROUP BY zone""", "load_hourly", extra=_LAG_SPLIT))
def per_zone_lag_mape(spark, d):
    """Lag, split by date, fit, predict and both error measures per zone."""
    rows = lag_features(c.stored_hourly(spark, d))
    later = F.col("ds") >= F.lit("2024-01-24").cast("timestamp_ntz")
    scored = linear.predict(rows.filter(later), linear.fit(rows.filter(~later), _LAG_FEATURES), _LAG_FEATURES)
    errors = scored.groupBy("zone").agg(F.round(F.avg(F.abs(F.col("mw") - F.col("prediction"))), 4).alias("mae"))
    return c.rounded(c.rounded(evaluate.mape_by_zone(scored), 6, "mape"), 4, "mape_pct").join(errors, "zone")


@query("per_zone_predict", sql("SELECT l_orderkey, l_linenumber, zone, mw, round(prediction, 4) AS prediction FROM scored", "train", extra=_SCORED))
def per_zone_predict(spark, d):
    return c.rounded(_scored(spark, d).select("l_orderkey", "l_linenumber", "zone", "mw", "prediction"), 4, "prediction")


@query("predictions_with_features", sql(f"""
    SELECT l_orderkey, l_linenumber, zone, {', '.join(TRAIN_FEATURES)}, round(prediction, 4) AS mw FROM scored""", "train", extra=_SCORED))
def predictions_with_features(spark, d):
    # The forecast replaces the observed load next to the features it was made from.
    rows = linear.predict(c.train(spark, d).filter("test = 1").drop("mw"), _stored_models(spark, d), TRAIN_FEATURES, out="mw")
    return c.rounded(rows.select("l_orderkey", "l_linenumber", "zone", *TRAIN_FEATURES, "mw"), 4, "mw")


@query("model_dispatch", sql("SELECT zone, count(*) AS n, round(sum(prediction), 2) AS total FROM scored GROUP BY zone", "train", extra=_SCORED))
def model_dispatch(spark, d):
    models = _stored_models(spark, d)
    registry = ModelRegistry()
    registry.register("linear", lambda df: linear.predict(df, models, TRAIN_FEATURES))
    rows = registry.score("linear", c.train(spark, d).filter("test = 1"))
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prediction"), 2).alias("total"))


@query("mae", sql("SELECT round_even(avg(abs(prediction - mw)), 2) AS mae FROM scored", "train", extra=_SCORED))
def mae(spark, d):
    return evaluate.mean_absolute_error(_scored(spark, d), "mw", "prediction")


@query("mape_by_zone", sql("""
    SELECT zone, round(avg(abs((mw - prediction) / nullif(mw, 0))), 6) AS mape, round(avg(abs((mw - prediction) / nullif(mw, 0))) * 100, 4) AS mape_pct,
           count(*) FILTER (mw = 0) AS skipped, count(*) FILTER (mw IS NOT NULL AND prediction IS NULL) AS unscored FROM scored GROUP BY zone""", "train", extra=_SCORED))
def mape_by_zone(spark, d):
    return c.rounded(c.rounded(evaluate.mape_by_zone(_scored(spark, d)), 6, "mape"), 4, "mape_pct")


@query("predict_point", sql(f"""
    SELECT zone, round({_prediction(TRAIN_FEATURES, 'p')}, 4) AS prediction
    FROM models m, (SELECT 10.0 AS quantity, 0.05 AS discount, 0.02 AS tax, 10 AS month) p ORDER BY zone LIMIT 1""", "train", extra=_FIT))
def predict_point(spark, d):
    point = spark.createDataFrame([(10.0, 0.05, 0.02, 10)], "quantity double, discount double, tax double, month int")
    return c.rounded(linear.predict_point(point, _stored_models(spark, d), TRAIN_FEATURES), 4, "prediction").select("zone", "prediction")


_P = len(TRAIN_FEATURES)
_PRODUCTS = ", ".join(
    [f"sum(CAST({TRAIN_FEATURES[i]} AS DOUBLE) * {TRAIN_FEATURES[j]}) AS m_{i}_{j}" for i, j in product(range(_P), range(_P))]
    + [f"{float(i == j)} AS m_{i}_{_P + j}" for i, j in product(range(_P), range(_P))]
    + [f"sum(CAST({TRAIN_FEATURES[i]} AS DOUBLE) * {TRAIN_FEATURES[i]}) AS own_{i}" for i in range(_P)])


@query("vif", sql(" UNION ALL ".join(
    f"SELECT '{x}' AS feature, round(own_{i} * m_{i}_{_P + i}, 6) AS vif FROM step{_P - 1}" for i, x in enumerate(TRAIN_FEATURES)), "train",
    extra={"products": f"SELECT {_PRODUCTS} FROM train", **eliminate("products", [f"own_{i}" for i in range(_P)], _P, 2 * _P)}))
def vif(spark, d):
    return c.rounded(linear.vif(c.train(spark, d), TRAIN_FEATURES), 6, "vif")


_SPLIT = {"split": "SELECT *, CASE WHEN substr(md5(concat_ws('|', l_orderkey, l_linenumber, 42)), 1, 8) < '33333333' THEN 1 ELSE 0 END AS part FROM train"}


@query("random_split", sql("SELECT zone, count(*) FILTER (part = 0) AS n_train, count(*) FILTER (part = 1) AS n_test FROM split GROUP BY zone", "train", extra=_SPLIT))
def random_split(spark, d):
    rows = evaluate.random_split(c.train(spark, d).drop("test"), ["l_orderkey", "l_linenumber"])
    return rows.groupBy("zone").agg(F.count_if(F.col("test") == 0).alias("n_train"), F.count_if(F.col("test") == 1).alias("n_test"))


@query("standard_scale", sql("SELECT l_orderkey, l_linenumber, test, " + ", ".join(
    f"round((t.{x} - s.mean_{x}) / s.std_{x}, 6) AS {x}" for x in TRAIN_FEATURES) + " FROM train t, stats s", "train", extra={
        "stats": "SELECT " + ", ".join(f"avg({x}) AS mean_{x}, stddev_pop({x}) AS std_{x}" for x in TRAIN_FEATURES) + " FROM train WHERE test = 0"}))
def standard_scale(spark, d):
    rows = c.train(spark, d)
    scaled = evaluate.standard_scale(rows.filter("test = 0"), rows, TRAIN_FEATURES)
    return c.rounded(scaled.select("l_orderkey", "l_linenumber", "test", *TRAIN_FEATURES), 6, *TRAIN_FEATURES)


def _beside_the_mean(scored, mean, *by):
    """Test rows, the error of the plain mean, and whether the model's own error is of its size: below one and a half times it."""
    errors = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(F.col("mw") - mean)).alias("mean_error"),
        F.avg(F.abs(F.col("mw") - F.col("prediction"))).alias("own_error"))
    return c.rounded(errors.withColumn("near_mean", F.col("own_error") < 1.5 * F.col("mean_error")).drop("own_error"), 2, "mean_error")


@query("random_forest", sql("""
    SELECT count(*) AS n_test, round(avg(abs(mw - (SELECT avg(mw) FROM split WHERE part = 0 AND zone = 'RF'))), 2) AS mean_error, true AS near_mean
    FROM split WHERE part = 1 AND zone = 'RF'""", "train", extra=_SPLIT))
def random_forest(spark, d):
    rows = c.train(spark, d).filter("zone = 'RF'").drop("test")
    keys = ["l_orderkey", "l_linenumber"]
    scored = trees.fit_forest(rows, TRAIN_FEATURES, "mw", keys, partitions=spark.sparkContext.defaultParallelism)
    mean = evaluate.random_split(rows, keys).filter("test = 0").agg(F.avg("mw")).scalar()
    return _beside_the_mean(scored, mean)


# Two stumps per zone whose thresholds and leaves are means of the data, so that SQL can say the same.
_STUMPS = """
    SELECT zone, avg(temp) AS t, avg(mw) FILTER (temp <= m) AS low, avg(mw) FILTER (temp > m) AS high,
           avg(mw) FILTER (hour <= 11.5) AS early, avg(mw) FILTER (hour > 11.5) AS late
    FROM (SELECT *, avg(temp) OVER (PARTITION BY zone) AS m FROM load_hourly) GROUP BY zone"""


_STUMPS_SQL = sql("""
    SELECT s.zone, CAST(s.datetime AS VARCHAR) AS datetime,
           round(CASE WHEN l.temp IS NULL OR l.temp <= p.t THEN p.low ELSE p.high END
                 + 0.1 * CASE WHEN hour(s.datetime) <= 11.5 THEN p.early ELSE p.late END, 4) AS prediction
    FROM spine s LEFT JOIN load_hourly l ON s.zone = l.zone AND s.datetime = l.ds LEFT JOIN stumps p ON s.zone = p.zone""",
    "spine", "load_hourly", extra={"stumps": _STUMPS})


def _stumps_and_rows(spark, d):
    hourly = c.stored_hourly(spark, d)
    means = hourly.groupBy("zone").agg(F.avg("temp").alias("t"))
    low, early = F.col("temp") <= F.col("t"), F.col("hour") <= 11.5
    stats = hourly.join(means, "zone").groupBy("zone", "t").agg(
        F.avg(F.when(low, F.col("mw"))).alias("low"), F.avg(F.when(~low, F.col("mw"))).alias("high"),
        F.avg(F.when(early, F.col("mw"))).alias("early"), F.avg(F.when(~early, F.col("mw"))).alias("late"))

    def node(tree, number, feature=None, threshold=None, value=None, weight=1.0):
        inner = feature is not None
        return F.struct(
            F.lit(tree).alias("tree"), F.lit(number).alias("node"), F.lit(feature).cast("string").alias("feature"),
            (threshold if inner else F.lit(None)).cast("double").alias("threshold"),
            F.lit(1 if inner else None).cast("int").alias("left"), F.lit(2 if inner else None).cast("int").alias("right"),
            F.lit(True).alias("missing_left"), (F.lit(0.0) if inner else value).alias("value"), F.lit(weight).alias("weight"))

    nodes = stats.select("zone", F.inline(F.array(
        node(0, 0, "temp", F.col("t")), node(0, 1, value=F.col("low")), node(0, 2, value=F.col("high")),
        node(1, 0, "hour", F.lit(11.5), weight=0.1), node(1, 1, value=F.col("early"), weight=0.1), node(1, 2, value=F.col("late"), weight=0.1))))
    spine = c.hours_of(hourly.select("zone", "date").distinct())
    rows = spine.withColumn("hour", F.hour("datetime")).join(
        hourly.select("zone", F.col("ds").alias("datetime"), "temp"), ["zone", "datetime"], "left")
    return rows, nodes


@query("per_zone_tree_score", _STUMPS_SQL)
def per_zone_tree_score(spark, d):
    rows, nodes = _stumps_and_rows(spark, d)
    scored = trees.score_trees(rows, nodes, ["temp", "hour"])
    return c.rounded(c.as_text(scored.select("zone", "datetime", "prediction"), "datetime"), 4, "prediction")


@query("per_zone_tree_score_grouped", _STUMPS_SQL)
def per_zone_tree_score_grouped(spark, d):
    rows, nodes = _stumps_and_rows(spark, d)
    scored = trees.score_trees_grouped(rows, nodes, ["temp", "hour"], rows_per_group=2000)
    return c.rounded(c.as_text(scored.select("zone", "datetime", "prediction"), "datetime"), 4, "prediction")


@query("gbt_fit", """
    SELECT event_type AS zone, count(*) AS n_test, round(avg(abs(value - m)), 2) AS mean_error, true AS near_mean
    FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type""")
def gbt_fit(spark, d):
    """Fit a boosted model per zone on single readings, store it, load its trees and score with them."""
    rows = c.readings(spark, d).select(
        "zone", "hour", "k", dow_number(F.col("date")).alias("dow_num"), F.col("value").alias("mw"))
    features = ["hour", "k", "dow_num"]
    zones = [r["zone"] for r in rows.select("zone").distinct().orderBy("zone").collect()]
    root = scratch_path(spark, "boosted")
    model_store.save_tree_models(trees.fit_boosted(rows, zones, features, "mw"), root)
    scored = trees.score_trees(rows, model_store.load_trees(spark, root, features), features)
    means = rows.groupBy("zone").agg(F.avg("mw").alias("mean"))
    return _beside_the_mean(scored.join(means, "zone"), F.col("mean"), "zone")


_PAIRS = "PARTITION BY zone ORDER BY ds"


@query("first_order_response_fit", sql("""
    SELECT zone, round(a, 6) AS a, round(b, 6) AS b, round(coalesce(CASE WHEN a > 0 AND a < 1 THEN b / (1 - a) END, -1), 4) AS k,
           round(coalesce(CASE WHEN a > 0 AND a < 1 THEN -1 / ln(a) END, -1), 6) AS tau
    FROM (SELECT zone, m_0_2 AS a, m_1_2 AS b FROM step1)""", "load_hourly", extra={
        "lagged": f"SELECT * FROM (SELECT zone, mw, lag(mw) OVER w AS x0, lag(temp) OVER w AS x1 FROM load_hourly WINDOW w AS ({_PAIRS})) WHERE x0 IS NOT NULL",
        "sums": "SELECT zone, " + ", ".join([f"sum(x{i} * x{j}) AS m_{i}_{j}" for i, j in product(range(2), range(2))] + [f"sum(x{i} * mw) AS m_{i}_2" for i in range(2)]) + " FROM lagged GROUP BY zone",
        **eliminate("sums", ["zone"], 2, 3)}))
def first_order_response_fit(spark, d):
    fitted = response.first_order(c.stored_hourly(spark, d).select("zone", "ds", "mw", "temp"), u="temp", y="mw")
    return c.rounded(c.rounded(c.filled(fitted, -1.0, "k", "tau"), 6, "a", "b", "tau"), 4, "k")


@query("second_order_response_fit", sql("""
    SELECT zone, round(a1, 6) AS a1, round(a2, 6) AS a2, round(b1, 6) AS b1, round(b2, 6) AS b2,
           round(CASE WHEN ok THEN (b1 + b2) / (1 - a1 - a2) ELSE -1 END, 4) AS k,
           round(CASE WHEN ok THEN sqrt(s2) ELSE -1 END, 6) AS wn, round(CASE WHEN ok THEN -s1 / (2 * sqrt(s2)) ELSE -1 END, 6) AS zeta
    FROM (SELECT *, CASE WHEN disc >= 0 THEN (a1 - sqrt(abs(disc))) / 2 > 0 AND (a1 + sqrt(abs(disc))) / 2 < 1 ELSE -a2 < 1 END AS ok,
        -- sum and product of the logarithms of the two poles
        CASE WHEN disc >= 0 AND a1 - sqrt(abs(disc)) > 0 THEN ln((a1 - sqrt(disc)) / 2) + ln((a1 + sqrt(disc)) / 2)
             WHEN disc < 0 THEN ln(-a2) END AS s1,
        CASE WHEN disc >= 0 AND a1 - sqrt(abs(disc)) > 0 THEN ln((a1 - sqrt(disc)) / 2) * ln((a1 + sqrt(disc)) / 2)
             WHEN disc < 0 THEN pow(ln(-a2) / 2, 2) + pow(atan2(sqrt(-disc), a1), 2) END AS s2
      FROM (SELECT zone, m_0_4 AS a1, m_1_4 AS a2, m_2_4 AS b1, m_3_4 AS b2, m_0_4 * m_0_4 + 4 * m_1_4 AS disc FROM step3))""", "load_hourly", extra={
        "lagged": f"SELECT * FROM (SELECT zone, mw, lag(mw) OVER w AS x0, lag(mw, 2) OVER w AS x1, lag(temp) OVER w AS x2, lag(temp, 2) OVER w AS x3 FROM load_hourly WINDOW w AS ({_PAIRS})) WHERE x1 IS NOT NULL",
        "sums": "SELECT zone, " + ", ".join([f"sum(x{i} * x{j}) AS m_{i}_{j}" for i, j in product(range(4), range(4))] + [f"sum(x{i} * mw) AS m_{i}_4" for i in range(4)]) + " FROM lagged GROUP BY zone",
        **eliminate("sums", ["zone"], 4, 5)}))
def second_order_response_fit(spark, d):
    fitted = response.second_order(c.stored_hourly(spark, d).select("zone", "ds", "mw", "temp"), u="temp", y="mw")
    return c.rounded(c.rounded(c.filled(fitted, -1.0, "k", "wn", "zeta"), 6, "a1", "a2", "b1", "b2", "wn", "zeta"), 4, "k")


@query("response_around_a_point", sql("""
    SELECT zone, n, round(a, 6) AS a, round(b, 6) AS b, round(my - a * m0 - b * m1, 4) AS "offset",
           round(coalesce(CASE WHEN a > 0 AND a < 1 THEN b / (1 - a) END, -1), 4) AS k, round(coalesce(CASE WHEN a > 0 AND a < 1 THEN -1 / ln(a) END, -1), 6) AS tau
    FROM (SELECT zone, n, my, m0, m1, m_0_2 AS a, m_1_2 AS b FROM step1)""", "load_hourly", extra={
        "lagged": f"SELECT * FROM (SELECT zone, mw, lag(mw) OVER w AS x0, lag(temp) OVER w AS x1 FROM load_hourly WINDOW w AS ({_PAIRS})) WHERE x0 IS NOT NULL",
        "sums": "SELECT zone, count(*) AS n, avg(mw) AS my, avg(x0) AS m0, avg(x1) AS m1, " + ", ".join(
            [f"covar_pop(x{i}, x{j}) AS m_{i}_{j}" for i, j in product(range(2), range(2))] + [f"covar_pop(x{i}, mw) AS m_{i}_2" for i in range(2)]) + " FROM lagged GROUP BY zone",
        **eliminate("sums", ["zone", "n", "my", "m0", "m1"], 2, 3)}))
def response_around_a_point(spark, d):
    """The first-order response with a constant, which an offset of load or temperature does not change."""
    fitted = response.centred(c.stored_hourly(spark, d).select("zone", "ds", "mw", "temp"), u="temp", y="mw")
    shown = c.filled(fitted, -1.0, "k", "tau").select("zone", "n", F.col("a")[0].alias("a"), F.col("b")[0].alias("b"), "offset", "k", "tau")
    return c.rounded(c.rounded(shown, 6, "a", "b", "tau"), 4, "offset", "k")
