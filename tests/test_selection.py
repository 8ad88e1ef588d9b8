import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridcast.operators import selection as sel


@pytest.fixture
def loads(frame):
    rows = [("AE", 0, 1.0), ("AE", 1, 2.0), ("AP", 0, 3.0), ("DOM", 1, None)]
    return frame(rows, "zone string, hour int, mw double")


def zones(frame, *names):
    return frame([(n,) for n in names], "zone string")


def names(df):
    return sorted({r["zone"] for r in df.collect()})


def test_subset_by_literals_and_by_table(frame, loads):
    assert names(sel.zone_subset(loads, ["AE", "DOM"])) == ["AE", "DOM"]
    # A zone listed twice must not double its rows.
    assert sel.zone_subset(loads, zones(frame, "AE", "AE")).count() == 2


def test_empty_selection_means_everything(frame, loads):
    assert sel.selection_or_all(loads, zones(frame)).count() == 4
    assert sel.selection_or_all(loads, zones(frame, "AP")).count() == 1


@pytest.mark.parametrize("chosen, state", [([], "empty"), (["AE"], "partial"), (["AE", "AP", "DOM"], "all")])
def test_selection_state(frame, loads, chosen, state):
    row = sel.selection_state(zones(frame, *chosen), loads).first()
    assert (row["state"], row["n_selected"], row["n_zones"]) == (state, len(chosen), 3)


def test_toggle_adds_removes_and_counts_repeats(frame):
    now = zones(frame, "AE", "AP")
    assert names(sel.toggle_selection(now, zones(frame, "AE", "DOM", "DOM", "DOM"))) == ["AP", "DOM"]
    assert names(sel.toggle_selection(now, zones(frame))) == ["AE", "AP"]


def test_flags_split_and_sets(frame, loads):
    flagged = sel.selected_flag(loads, ["AE"]).collect()
    assert {(r["zone"], r["selected"]) for r in flagged} == {("AE", "True"), ("AP", "False"), ("DOM", "False")}
    train, test = sel.flag_split(loads.withColumn("test", F.col("hour")))
    assert (train.count(), test.count()) == (2, 2)
    inside = loads.withColumn("x", sel.in_hour_set(F.col("hour"))).filter("x")
    assert inside.count() == 2
    assert sel.drop_incomplete(loads).count() == 3
    assert sel.single_zone(loads, "AP").count() == 1


def test_non_empty(loads):
    assert sel.non_empty(loads).first()[0] is True
    assert sel.non_empty(loads.filter("false")).first()[0] is False


def test_member_filter_uses_all_fields(frame):
    rows = frame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "name string, lat double")
    members = frame([("a", 1.0), ("b", 2.0)], "name string, lat double")
    assert [tuple(r) for r in sel.member_filter(rows, members, ["name", "lat"]).collect()] == [("a", 1.0)]


def test_time_slice_is_one_hour_with_attributes(frame):
    t = lambda h, m=0: dt.datetime(2022, 11, 16, h, m)
    rows = frame([("AE", t(17)), ("AE", t(18)), ("AE", t(18, 30)), ("AE", t(19)), ("XX", t(18))], "zone string, ds timestamp_ntz")
    dim = frame([("AE", 39.45)], "zone string, lat double")
    got = sel.time_slice(rows, dim, "2022-11-16", 18).collect()
    assert sorted(r["ds"] for r in got) == [t(18), t(18, 30)] and {r["lat"] for r in got} == {39.45}


def test_first_rows(loads):
    assert [r["mw"] for r in sel.first_rows(loads.filter("mw is not null"), 2, "mw").collect()] == [1.0, 2.0]
