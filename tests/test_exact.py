"""Values that only some rows show: microseconds, exact ties, flat peaks. Compared exactly, not to nine digits."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake import plans
from tests.compare import connect

SF = "/root/testdata/sf0.001"


def exact(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ["t03_sets_of_events", "t04_heart_rate_of_open_sets"])
def test_replay_keeps_microseconds(spark, name):
    rel = connect(SF).sql(plans.oracles()[name])
    assert exact(plans.queries()[name](spark, SF), rel.columns) == sorted(rel.fetchall())


def test_sample_utc_to_the_microsecond(spark):
    rel = connect(SF).sql(plans.oracles()["s03_sample_utc"])
    got = plans.queries()["s03_sample_utc"](spark, SF)
    assert {tuple(r) for r in got.select(*rel.columns).collect()} == set(rel.fetchall())


def test_with_utc_adds_whole_microseconds(spark):
    from barlake.sources import recordings

    start = dt.datetime(2026, 6, 15, 10, 0, 0, tzinfo=dt.timezone.utc)
    cars = spark.createDataFrame([("a", start, 1000.0)], "recording_id string, startedAt timestamp, clockAnchorUptimeSeconds double")
    times = [1000.000001, 1000.123457, 1002.999999]
    rows = recordings.with_utc(spark.createDataFrame([("a", t) for t in times], "recording_id string, t double"), cars)
    assert [r[0] - int(start.timestamp()) * 10**6 for r in rows.orderBy("t").select(F.unix_micros("utc")).collect()] == [1, 123457, 2999999]


def test_label_of_a_half_goes_up(spark):
    from barlake.operators import trajectories as traj

    # the middle is 322.2 / 640, a half of the sixth place, which doubles may hold a little too low
    rows = spark.createDataFrame([("a", 0, 322.2 - 45 - 3e-11, 322.2 + 45, 0.0, 90.0)], "clip string, i long, x0 double, x1 double, y0 double, y1 double")
    assert traj.boxes(rows, 15, 640, 480).first()["label"] == "0 0.503438 0.093750 0.140625 0.187500"


def test_flat_peaks_count_by_their_middle(spark):
    from barlake.operators import recordings as rec
    from barlake.plans.recordings import PEAKS
    from tests.compare import rows_of

    values = [0.0, 30.0, 30.0, 30.0, 1.0, 7.0, 40.0, 2.0, 22.0, 22.0, 3.0, 9.0, 9.0, 50.0, 50.0]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "recording_id long, i long, a double")
    con = connect(SF)
    con.execute(f"create table series as select 1 as recording_id, i - 1 as i, v as a from (select unnest({values}::double[]) as v, generate_subscripts({values}, 1) as i)")
    rel = con.sql("with " + PEAKS)
    got = rec.find_peaks(rows, 4, 20.0)
    assert rows_of(got.columns, got.collect()) == rows_of(list(rel.columns), rel.fetchall())
    assert [(r["i"], r["prominence"]) for r in got.orderBy("i").collect()] == [(2, 29.0), (6, 38.0)]


def test_prominence_at_its_bound_counts(spark):
    from barlake.functions import signal

    assert signal.peaks(np.array([0.0, 0.3 - 0.1, 0.0]), 1, 0.2).tolist() == signal.peaks(np.array([0.0, 0.2, 0.0]), 1, 0.2).tolist() == [1]


def test_board_cell_of_a_half_goes_up(spark):
    from barlake.operators import repmetrics as rm

    # what averages to 2.5 may fall short of it as a sum of doubles
    rows = spark.createDataFrame([("a", "v", 2.5 - 4e-16, ""), ("b", "v", 1.5, "")], "set_id string, vendor string, value double, flag string")
    assert {r["set_id"]: r["cell"] for r in rm.board_cells(rows, 0).collect()} == {"a": "1·3", "b": "1·2"}


def test_sizes_at_the_bound_are_active(spark):
    from barlake.operators import series

    # a tenth of 3 is 0.3, which 0.1 + 0.2 - 1e-16 reaches but for rounding
    rows = spark.createDataFrame([("a", 3.0), ("a", 0.3 - 1e-15), ("a", 0.2)], "recording_id string, a double")
    assert series.concentric_velocity(rows, ["recording_id"], "a").first()["mean_velocity"] == pytest.approx(1.65)


def test_velocity_logs_are_packed(spark, tmp_path, monkeypatch):
    from barlake.plans import imports
    from barlake.views import read

    monkeypatch.setattr(imports, "shared_folder", lambda _: str(tmp_path))
    assert imports.velocity_logs(spark, SF).count() == read(spark, SF, "events").count()
    assert 0 < len(list(tmp_path.rglob("part-*[!c]"))) <= 4 < read(spark, SF, "events").select("user_id").distinct().count()


def test_block_lags_are_those_of_each_pair(monkeypatch):
    from barlake.functions import signal
    from barlake.operators import alignment

    rng = np.random.default_rng(3)
    left, right = ([np.cumsum(rng.normal(size=int(n))) for n in rng.integers(1, 90, 12)] for _ in "ab")
    sizes, flat = lambda many: np.array([len(x) for x in many]), np.concatenate
    wanted = rng.random((12, 12)) < 0.7
    monkeypatch.setattr(alignment, "FLAT", 1 << 10)  # several rounds of spectra
    found = {(i, j): (r, lag) for part in alignment.best_lags(sizes(left), flat(left), sizes(right), flat(right), wanted) for i, j, r, lag in zip(*part)}
    assert set(found) == set(zip(*np.nonzero(wanted)))
    for (i, j), (r, lag) in found.items():
        one, at = signal.correlate_lags(left[i], right[j])
        assert r == pytest.approx(one, abs=1e-9) and (lag == at or abs(one) < 1e-9)


def test_windows_of_tracks_share_a_sort(spark):
    from barlake.operators import trajectories as traj

    tracks = spark.createDataFrame([(1, 0, k, 1.0, 2.0, 3.0) for k in range(20)], "clip long, track int, frame int, cx double, cy double, r double")
    plan = traj.filled_tracks(tracks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2  # linked rows, then filled ones
