"""Boosted trees on the day-ahead feature frame, in which part of the weather is missing, and the same trees in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.common import query, sql
from gridcast.bindings.selection_queries import _HOLIDAY
from gridcast.models import boosting, trees
from gridcast.schemas import BATCH_FEATURES
from gridcast.session import materialize

CIRCULAR = ("hour_cos", "hour_sin", "month_cos", "month_sin")
BINS = 32


def _circle(part: str, period: int) -> tuple[str, str]:
    return tuple(f"round({f}(2 * pi() / {period} * {part}(s.datetime)), 6) + 0.0" for f in ("cos", "sin"))


# The 20 columns of the feature frame and the load, null in hours without readings.
GAP_FRAME = {
    "gap_weather": "SELECT * FROM weather WHERE windspeed >= 2",
    "frame": f"""
        SELECT s.zone, s.datetime, CAST(s.datetime AS DATE) AS date, CAST(hour(s.datetime) AS INTEGER) AS hour,
               CAST(year(s.datetime) AS INTEGER) AS year, isodow(s.datetime) >= 6 AS weekend, {_HOLIDAY.format(d='CAST(s.datetime AS DATE)')} AS holiday,
               is_dst, s.datetime BETWEEN TIMESTAMP '2020-03-18' AND TIMESTAMP '2020-06-30' AS is_sah,
               s.datetime < TIMESTAMP '2020-03-18' AS precovid, s.datetime > TIMESTAMP '2020-06-30' AS postcovid,
               w.temp, precip, rh, pressure, windspeed, rain, snow, 1 AS recent, {_circle('hour', 23)[0]} AS hour_cos, {_circle('hour', 23)[1]} AS hour_sin,
               {_circle('month', 11)[0]} AS month_cos, {_circle('month', 11)[1]} AS month_sin, isodow(s.datetime) AS dow_num, l.mw
        FROM real_spine s LEFT JOIN gap_weather w ON s.zone = w.zone AND s.datetime = w.datetime
            LEFT JOIN load_hourly l ON s.zone = l.zone AND s.datetime = l.ds""",
}


def gap_frame(spark, d):
    """Every hour with its features and load, written once. Hours with one reading only report no pressure, so their weather is
    missing though their load is known."""
    frame = c.rounded(c.features(spark, d, least_readings=2), 6, *CIRCULAR).withColumns({x: F.col(x) + 0.0 for x in CIRCULAR})
    hourly = c.load_hourly(spark, d).select("zone", F.col("ds").alias("datetime"), "mw")
    return materialize(frame.join(hourly, ["zone", "datetime"], "left"), "frame")


def boosted_views(source: str, features: list[str], rounds: int, depth: int, rate: float, bins: int = BINS, l2: float = 1.0,
                  min_rows: int = 5) -> dict[str, str]:
    """Views over (zone, datetime, features, mw): ``cuts``, ``split_t_l`` for each tree and level, and ``scored``."""
    numbers = [f"CAST({f} AS DOUBLE)" for f in features]
    shares = "[" + ", ".join(str(i / bins) for i in range(1, bins)) + "]"
    cuts = ", ".join(f"coalesce(list_sort(list_distinct(quantile_disc({x}, {shares}))), [])" for x in numbers)
    binned = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN len(list_filter(cuts[{i + 1}], lambda v: v < {x})) END" for i, (f, x) in enumerate(zip(features, numbers)))
    views = {
        "cuts": f"SELECT zone, avg(mw) AS base, [{cuts}] AS cuts FROM {source} WHERE mw IS NOT NULL GROUP BY zone",
        "rows_1": f"""SELECT s.zone, s.datetime, s.mw, base AS score, mw - base AS residual, [{binned}] AS bins
            FROM {source} s JOIN cuts USING (zone)""",
    }
    of_feature = "PARTITION BY zone, node, feature"
    for t in range(1, rounds + 1):
        views[f"at_{t}_0"] = f"SELECT *, 0 AS node, CAST(0 AS DOUBLE) AS value FROM rows_{t}"
        for k in range(depth):
            views[f"sums_{t}_{k}"] = f"""
                SELECT zone, node, feature, bin, sum(residual) AS g, count(*) AS n
                FROM (SELECT zone, node, residual, unnest(range({len(features)})) AS feature, unnest(bins) AS bin
                      FROM at_{t}_{k} WHERE node IS NOT NULL AND residual IS NOT NULL) GROUP BY ALL"""
            run = ", ".join(f"""
                coalesce(sum(CASE WHEN bin IS NOT NULL THEN {x} END) OVER ({of_feature} ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING), 0) AS {x}_left,
                coalesce(sum(CASE WHEN bin IS NULL THEN {x} END) OVER ({of_feature}), 0) AS {x}_gaps, sum({x}) OVER ({of_feature}) AS {x}_all""" for x in "gn")
            views[f"split_{t}_{k}"] = f"""
                SELECT zone, node, feature, bin AS cut, missing_left, gl / (nl + {l2}) AS left_value, (g_all - gl) / (n_all - nl + {l2}) AS right_value, gain, CAST(n_all AS BIGINT) AS n
                FROM (SELECT *, row_number() OVER (PARTITION BY zone, node ORDER BY gain DESC, feature, bin, missing_left DESC) AS place
                  FROM (SELECT *, round(gl * gl / (nl + {l2}) + (g_all - gl) * (g_all - gl) / (n_all - nl + {l2}) - g_all * g_all / (n_all + {l2}), {boosting.GAIN_DIGITS}) AS gain
                    FROM (SELECT zone, node, feature, bin, g_all, n_all, n_gaps, missing_left,
                                 g_left + CASE WHEN missing_left THEN g_gaps ELSE 0 END AS gl, n_left + CASE WHEN missing_left THEN n_gaps ELSE 0 END AS nl
                          FROM (SELECT zone, node, feature, bin, {run} FROM sums_{t}_{k}), (VALUES (true), (false)) m(missing_left)
                          WHERE bin IS NOT NULL AND (missing_left OR n_gaps > 0))
                    WHERE nl >= {min_rows} AND n_all - nl >= {min_rows}))
                WHERE place = 1 AND gain > 0"""
            left = "coalesce(a.bins[s.feature + 1] <= s.cut, s.missing_left)"
            views[f"at_{t}_{k + 1}"] = f"""
                SELECT a.zone, a.datetime, a.mw, a.score, a.residual, a.bins, CASE WHEN s.node IS NOT NULL THEN 2 * a.node + CASE WHEN {left} THEN 1 ELSE 2 END END AS node,
                       CASE WHEN s.node IS NULL THEN a.value WHEN {left} THEN s.left_value ELSE s.right_value END AS value
                FROM at_{t}_{k} a LEFT JOIN split_{t}_{k} s ON a.zone = s.zone AND a.node = s.node"""
        views[f"rows_{t + 1}"] = f"SELECT zone, datetime, mw, score + {rate} * value AS score, residual - {rate} * value AS residual, bins FROM at_{t}_{depth}"
    views["scored"] = f"SELECT zone, datetime, mw, score FROM rows_{rounds + 1}"
    return views


_SMALL = dict(rounds=2, depth=2, rate=0.3)
_TREES = {
    **GAP_FRAME, **boosted_views("frame", BATCH_FEATURES, **_SMALL),
    "grown": " UNION ALL ".join(f"SELECT *, {t} AS tree FROM split_{t}_{k}" for t in (1, 2) for k in range(2)),
    "names": "SELECT [" + ", ".join(f"'{f}'" for f in BATCH_FEATURES) + "] AS names",
    "ends": """SELECT zone, tree, 2 * node + 1 AS node, left_value AS value FROM grown UNION ALL SELECT zone, tree, 2 * node + 2, right_value FROM grown""",
}


def _fit(frame):
    return materialize(boosting.fit(frame, BATCH_FEATURES, bins=BINS, **_SMALL), "trees")


@query("boosted_fit", sql("""
    SELECT zone, tree, node, names[feature + 1] AS feature, round(coalesce(cuts[feature + 1][cut + 1], 999999), 6) AS threshold, missing_left, round(gain, 2) AS gain, n,
           CAST(0 AS DOUBLE) AS value
    FROM grown JOIN cuts USING (zone), names
    UNION ALL SELECT zone, tree, node, 'leaf', CAST(-1 AS DOUBLE), true, CAST(-1 AS DOUBLE), -1, round(value, 4) FROM ends ANTI JOIN grown USING (zone, tree, node)
    UNION ALL SELECT zone, 0, 0, 'leaf', -1, true, -1, -1, round(base, 4) FROM cuts""", "real_spine", "weather", "load_hourly", extra=_TREES))
def boosted_fit(spark, d):
    """All nodes of the first trees: features, thresholds, default branches and values."""
    nodes = _fit(gap_frame(spark, d))
    open_end = F.when(F.col("threshold") == float("inf"), 999999.0).otherwise(F.col("threshold"))
    shown = nodes.select("zone", "tree", "node", F.coalesce("feature", F.lit("leaf")).alias("feature"), F.coalesce(F.round(open_end, 6), F.lit(-1.0)).alias("threshold"),
                         "missing_left", F.coalesce(F.round("gain", 2), F.lit(-1.0)).alias("gain"), F.coalesce("n", F.lit(-1)).alias("n"), "value")
    return c.rounded(shown, 4, "value")


@query("boosted_score_gaps", sql("""
    SELECT zone, CAST(datetime AS VARCHAR) AS datetime, round(score, 4) AS prediction FROM scored SEMI JOIN (SELECT * FROM frame WHERE temp IS NULL) g USING (zone, datetime)""",
    "real_spine", "weather", "load_hourly", extra=_TREES))
def boosted_score_gaps(spark, d):
    """Forecasts of the hours whose weather is missing: the default branches decide."""
    frame = gap_frame(spark, d)
    scored = trees.score_trees(frame.filter("temp IS NULL"), _fit(frame), BATCH_FEATURES)
    return c.rounded(c.as_text(scored.select("zone", "datetime", "prediction"), "datetime"), 4, "prediction")
