"""Rep measures against their definitions in plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.functions import slopes
from barlake.operators import order
from barlake.operators import repmetrics as rm


def rows(spark, values, flags=None, vendor="a", set_id="s"):
    flags = flags or [""] * len(values)
    data = [(set_id, vendor, k, None if v is None else float(v), f) for k, (v, f) in enumerate(zip(values, flags), 1)]
    return spark.createDataFrame(data, "set_id string, vendor string, rep int, value double, flag string")


FLAGS = ["", "", "", None, "phantom", "missed", "partial_rom", "undercount"]


def random_sets(seed, n=120):
    """set: rows (value, flag) in order, of all lengths, with nulls, flags, ties and values of any sign."""
    rng = random.Random(seed)
    return {f"s{k}": [(rng.choice([None, round(rng.uniform(-0.3, 1.2), 2), 0.5]) if rng.random() < 0.3 else round(rng.uniform(0.1, 1.2), 2), rng.choice(FLAGS)) for _ in range(rng.randrange(1, 14))] for k in range(n)}


def frame_of(spark, sets, vendor="a"):
    data = [(s, vendor, k, v, f) for s, reps in sets.items() for k, (v, f) in enumerate(reps, 1)]
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, "set_id string, vendor string, rep int, value double, flag string")


def good(reps):
    return [v for v, f in reps if v is not None and f not in ("phantom", "missed")]


def loss_by_definition(reps, k, exclude):
    """Best less the mean of the last ones, over the best: by the words of the definition."""
    values = good(reps)
    if len(values) < 3 or max(values) <= 0:
        return None
    tail = [v for v, f in reps if v is not None and f not in ("phantom", "missed", "partial_rom")] if exclude else values
    if len(tail) < 3:
        tail = values
    last = tail[-max(1, min(k, len(values) - 1, len(tail))) :]
    return 100 * (max(values) - sum(last) / len(last)) / max(values)


@pytest.mark.parametrize("k, exclude", [(1, False), (2, False), (2, True), (5, False), (5, True), (9, True)])
def test_velocity_loss_by_its_definition(spark, k, exclude):
    sets = random_sets(k)
    got = {r["set_id"]: r for r in rm.velocity_loss(frame_of(spark, sets), k=k, exclude_partial=exclude).collect()}
    assert set(got) == set(sets)
    for s, reps in sets.items():
        want = loss_by_definition(reps, k, exclude)
        assert got[s]["n_reps"] == len(good(reps)) and got[s]["best"] == max(good(reps), default=None)
        assert got[s]["velocity_loss"] == (None if want is None else pytest.approx(want))


def test_set_summary_by_its_definition(spark):
    sets = random_sets(77)
    for r in rm.set_summary(frame_of(spark, sets)).collect():
        values = [(v, "") for v, _ in sets[r["set_id"]] if v is not None]
        assert r["n_reps"] == len(sets[r["set_id"]]) and r["velocity_loss"] == pytest.approx(loss_by_definition(values, 2, False) or 0.0) and r["confidence"] == 0


def test_numbering_takes_usable_rows_in_order(spark):
    sets = random_sets(5)
    got = {}
    for r in rm.numbered(frame_of(spark, sets)).orderBy("set_id", "pos").collect():
        got.setdefault(r["set_id"], []).append(r["value"])
    assert got == {s: good(reps) for s, reps in sets.items() if good(reps)}


def test_errors_need_equal_counts(spark):
    one, two = random_sets(6), random_sets(7)
    got = {r["set_id"]: r for r in rm.rmse_bias(frame_of(spark, one, "a").unionByName(frame_of(spark, two, "b")), "a", "b").collect()}
    equal = 0
    for s in one:
        a, b = good(one[s]), good(two[s])
        if len(a) == len(b) and a:
            equal += 1
            d = [x - y for x, y in zip(a, b)]
            assert got[s]["bias"] == pytest.approx(sum(d) / len(d)) and got[s]["rmse"] == pytest.approx(math.sqrt(sum(x * x for x in d) / len(d)))
        elif a or b:
            assert got[s]["bias"] is None and got[s]["rmse"] is None
    assert equal > 3


def test_panel_keeps_shape_where_counts_differ(spark):
    ghost = rows(spark, [0.50, 0.45, 0.40, 0.0], ["", "", "", ""], vendor="a").unionByName(rows(spark, [0.55, 0.50, 0.45], vendor="b"))
    panel = rm.compare_panel(ghost, "a", "b").first()
    assert panel["rmse"] is None and not panel["aligned"] and panel["slope_source"] is not None
    tagged = rows(spark, [0.50, 0.45, 0.40, 0.0], ["", "", "", "phantom"], vendor="a").unionByName(rows(spark, [0.55, 0.50, 0.45], vendor="b"))
    assert rm.compare_panel(tagged, "a", "b").first()["aligned"]


def test_theil_sen_by_all_pairs(spark):
    sets = random_sets(8)
    got = {r["set_id"]: r["slope"] for r in rm.theil_sen(frame_of(spark, sets)).collect()}
    for s, reps in sets.items():
        v = good(reps)
        slopes = [(v[j] - v[i]) / (j - i) for i in range(len(v)) for j in range(i + 1, len(v))]
        assert got[s] == (pytest.approx(statistics.median(slopes)) if slopes else None)


def test_slope_selection(monkeypatch):
    """By inversions as by all pairs: noise, ties, walks with jumps, equal values; few slopes left to the end or hardly any."""
    rng = np.random.default_rng(17)
    monkeypatch.setattr(slopes, "SMALL", 1)
    for t in range(120):
        n = int(rng.integers(2, 60))
        v = (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.full(n, 2.5), np.cumsum(rng.standard_cauchy(n)))[t % 4]
        i, j = np.triu_indices(n, 1)
        want = float(np.median((v[j] - v[i]) / (j - i)))
        for left in (8, 0.2):
            monkeypatch.setattr(slopes, "LEFT", left)
            assert slopes.median_slope(v) == pytest.approx(want, abs=1e-9 * max(1, abs(want)))
    assert slopes.median_slope(np.zeros(1)) is None
    n = 200_000
    assert slopes.median_slope(0.25 * np.arange(n) + rng.normal(size=n)) == pytest.approx(0.25, abs=1e-6)


def test_quantiles_by_places(spark):
    rng = np.random.default_rng(18)
    groups = {g: np.round(rng.normal(size=n), 1) for g, n in (("a", 1), ("b", 2), ("c", 999), (None, 7))}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("empty", None)], "g string, value double").repartition(7)
    shares = {"low": 0.05, "middle": 0.5, "high": 0.95, "least": 0.0, "most": 1.0}
    got = {r.g: [r[n] for n in shares] for r in order.quantiles(rows, "g", "value", shares).collect()}
    assert got == {g: pytest.approx([float(np.quantile(v, q)) for q in shares.values()]) for g, v in groups.items()}
    places = order.placed(rows, ["value"], ["g"]).collect()
    assert sorted((str(r.g), r.place) for r in places) == sorted((str(g), k) for g, n in (("a", 2), ("b", 2), ("c", 999), (None, 7), ("empty", 1)) for k in range(n))


def test_median_of_all_other_groups(spark):
    rng = np.random.default_rng(19)
    groups = {f"g{k}": np.round(rng.normal(k % 3, 1, int(rng.integers(1, 9))), 1) for k in range(60)} | {"huge": np.full(300, 0.5), None: np.array([9.0])}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("bare", None)], "g string, value double").repartition(5)
    got = {r.g: (r.others, r.blind) for r in rm.leave_one_out_median(rows, "g").collect()}
    for g, v in groups.items():
        others = float(np.median(np.concatenate([w for h, w in groups.items() if h != g])))
        assert got[g] == (pytest.approx(others), pytest.approx(float(np.abs(v - others).mean())))
    assert got["bare"][0] == pytest.approx(float(np.median(np.concatenate(list(groups.values()))))) and got["bare"][1] is None
    assert rm.leave_one_out_median(rows.where("g = 'huge'"), "g").first()["others"] is None


def test_constant_side_has_no_correlation(spark):
    both = rows(spark, [1, 1, 1], vendor="a").unionByName(rows(spark, [1, 2, 3], vendor="b"))
    assert rm.watch_board(rm.head_pairs(both, "a", "b")).first()["r"] is None


def test_strict_pairs_raise(spark):
    both = rows(spark, [1, 2], vendor="a").unionByName(rows(spark, [1, 2, 3], vendor="b"))
    with pytest.raises(Exception, match="counts differ"):
        rm.strict_pairs(both, "a", "b").collect()


def test_leave_one_out_never_trains_on_the_held_out(spark):
    items = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0)], "g string, value double")
    got = {r["g"]: r["blind"] for r in rm.leave_one_out(items, "g").collect()}
    assert got == {"a": 4.0, "b": 4.0}
    fit = lambda df: df.agg(F.avg("value")).first()[0]
    score = lambda df, p: df.groupBy("g").agg(F.avg(F.abs(F.col("value") - p)).alias("blind"))
    assert {r["g"]: r["blind"] for r in rm.leave_one_out_with(items, "g", fit, score).collect()} == got


def test_consensus(spark):
    a = spark.createDataFrame([("x", 10, 0.5, 0.9), ("y", 10, 0.5, 0.9), ("z", 10, 0.5, 0.3)], "set_id string, n int, mean double, visibility double")
    b = spark.createDataFrame([("x", 9, 0.5), ("y", 9, 0.9), ("z", 10, 0.5)], "set_id string, n int, mean double")
    got = {r["set_id"]: (r["spine"], r["confidence"]) for r in rm.consensus(a, b).collect()}
    assert got == {"x": ("pose", "HIGH"), "y": ("pose", "MEDIUM"), "z": ("fallback", "LOW")}
