"""The day-ahead job as one query: landed documents to the published peak table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.bindings import common as c
from gridcast.bindings.boosting_queries import BINS, GAP_FRAME, boosted_views, gap_frame
from gridcast.bindings.common import query, sql
from gridcast.models import boosting, trees
from gridcast.plans.day_ahead import day_ahead_tables
from gridcast.schemas import BATCH_FEATURES
from gridcast.session import materialize

_TREES = dict(rounds=3, depth=2, rate=0.4)

# Hours of one leaf have one forecast: loads are decimals, so that equal totals of hours are equal in any order of addition.
_PIPELINE = {
    **GAP_FRAME, **boosted_views("frame", BATCH_FEATURES, **_TREES),
    "forecast": "SELECT zone, CAST(datetime AS DATE) AS date, CAST(hour(datetime) AS INTEGER) AS hour, CAST(score AS DECIMAL(18, 4)) AS mw FROM scored",
    "totals": "SELECT date, hour, sum(mw) AS mw FROM forecast GROUP BY date, hour",
    "tops": "SELECT date, arg_max(hour, (mw, -hour)) AS peak_hour FROM totals GROUP BY date",
}


@query("day_ahead_pipeline", sql("""
    SELECT f.zone, CAST(f.date AS VARCHAR) AS date, f.hour AS peak_hour, CAST(f.mw AS DOUBLE) AS peak_hour_mw, d.hist_peak_mw,
           round(CAST(f.mw AS DOUBLE) / nullif(d.hist_peak_mw, 0), 6) AS pct_hist_peak_mw
    FROM forecast f JOIN tops p ON f.date = p.date AND f.hour = p.peak_hour LEFT JOIN zone_dim d ON f.zone = d.zone""",
    "real_spine", "weather", "zone_dim", extra=_PIPELINE))
def day_ahead_pipeline(spark, d):
    """Documents to the 20 features, stored boosted trees per zone, a score for every hour, also those without weather, and the
    published tables. Frame, trees and scores are each written once."""
    frame = gap_frame(spark, d)
    nodes = materialize(boosting.fit(frame, BATCH_FEATURES, bins=BINS, **_TREES), "trees")
    scored = trees.score_trees(frame.drop("mw"), nodes, BATCH_FEATURES, out="mw")
    scored = materialize(scored.withColumn("mw", F.col("mw").cast("decimal(18,4)")), "scored")
    dim = c.stored_zone_dim(spark, c.zone_dim(c.load_hourly(spark, d)))
    peak = day_ahead_tables(scored, dim, c.BY_DAY).peak.withColumn("peak_hour_mw", F.col("peak_hour_mw").cast("double"))
    return c.rounded(c.as_text(peak, "date"), 6, "pct_hist_peak_mw")
