"""Signal primitives and segmenters against closed forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.functions import signal as s
from barlake.functions import vertical_acceleration
from barlake.operators import recordings as rec
from barlake.operators import series
from barlake.operators import trajectories as traj
from barlake.sources.recordings import synthetic_set


def hill(height, seconds, fs=40.0):
    """Up and down along a fifth-degree step, at rest at both ends."""
    u = np.linspace(0, 1, max(4, int(seconds * fs / 2)))
    up = height * u**3 * (10 - 15 * u + 6 * u * u)
    return np.concatenate((up, up[::-1]))


def session(hills, pauses, fs=40.0):
    """Hills (height, seconds) behind pauses of so many seconds, with rest halfway up before and behind; and where each has its bottom."""
    rest = np.full(int(fs), hills[0][0] / 2)
    parts, bottoms, at = [rest], [], int(fs)
    for (height, seconds), pause in zip(hills, pauses):
        parts += [np.zeros(int(pause * fs)), hill(height, seconds, fs)]
        at += int(pause * fs)
        bottoms.append(at)
        at += len(parts[-1])
    return np.concatenate([*parts, rest]), bottoms


def test_filter_keeps_a_passed_sine_and_drops_a_stopped_one():
    t = np.arange(0, 20, 0.01)
    slow, fast = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 5 * t)
    high = s.zero_phase(slow + fast, 1.0, 100.0, "high")
    low = s.zero_phase(slow + fast, 1.0, 100.0, "low")
    assert np.abs(high - fast)[200:-200].max() < 0.02
    assert np.abs(low - slow)[200:-200].max() < 0.02
    assert np.allclose(s.zero_phase(np.ones(50), 1.0, 100.0, "low"), 1.0)


def test_peaks():
    assert s.peaks(np.array([0, 1, 1, 1, 0, 3, 0.0])).tolist() == [2, 5]
    assert s.peaks(np.array([0, 2, 0, 3, 0, 2, 0.0]), distance=3).tolist() == [3]
    assert s.peaks(np.array([0, 5, 4.5, 5.2, 0.0]), prominence=1).tolist() == [3]


def test_smoothing_is_exact_on_a_parabola():
    x = np.arange(30.0)
    y = 2 + 3 * x - 0.5 * x**2
    assert np.allclose(s.smooth(y, 7), y)
    assert np.allclose(s.smooth(y, 7, derivative=1, dt=0.5), (3 - x) / 0.5)


def test_anchored_velocity_is_zero_at_anchors_and_like_the_windows(spark):
    rng = np.random.default_rng(3)
    t, a = np.cumsum(rng.uniform(0.5, 1.5, 200)), rng.normal(size=200)
    v = s.anchored_velocity(t, a, [50, 120])
    assert np.abs(v[[0, 50, 120, 199]]).max() < 1e-12
    frame = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "i": range(200), "t": t, "a": a, "anchor": [k in (50, 120) for k in range(200)]}))
    got = series.zero_velocity_integral(frame).orderBy("i").toPandas()["v"].to_numpy()
    assert np.abs(got - v).max() < 1e-9


def test_excursions_of_random_sessions_are_all_found():
    rng = np.random.default_rng(21)
    for _ in range(40):
        n = int(rng.integers(4, 13))
        height, seconds = rng.uniform(0.2, 0.7), rng.uniform(1.6, 3.5)
        hills = [(height * rng.uniform(0.9, 1.1), seconds * rng.uniform(0.9, 1.1)) for _ in range(n)]
        wave, bottoms = session(hills, rng.uniform(0.1, 0.3, n))
        pairs = rec.wave_pairs(wave, 40.0)
        assert len(pairs) == n
        tops = [b + np.argmax(wave[b : b + int(seconds * 50)]) for b in bottoms]
        assert all(abs(got - top) <= 2 for (_, got), top in zip(pairs, tops))


def test_ends_are_stripped_and_the_middle_is_not(spark):
    rng, waves, want = np.random.default_rng(22), {}, {}
    for _ in range(20):
        n, height = int(rng.integers(5, 10)), rng.uniform(0.3, 0.6)
        body, short = [(height, 2.2)] * n, (0.62 * height, 2.2)
        for hills, pauses, left, found in (
            ([*body, short], [0.2] * (n + 1), n, n + 1),
            ([short, *body], [0.2] * (n + 1), n, n + 1),
            ([(height, 2.2), *body], [0.2, 7.0, *[0.2] * (n - 1)], n, n + 1),
            ([*body, (height, 2.2)], [*[0.2] * n, 7.0], n + 1, n + 1),
            ([*body[:2], (0.15 * height, 1.6), *body[2:]], [0.2] * (n + 1), n, n),
        ):
            waves[len(waves)], want[len(want)] = session(hills, pauses)[0], (left, found)
    frame = spark.createDataFrame(pd.concat([pd.DataFrame({"recording_id": k, "t": np.arange(len(w)) / 40.0, "pos": w}) for k, w in waves.items()]))
    count = lambda df: {r.recording_id: r["count"] for r in df.groupBy("recording_id").count().collect()}
    assert count(rec.wave_excursions(frame)) == {k: v[0] for k, v in want.items()}
    assert count(rec.wave_excursions(frame, strip=False)) == {k: v[1] for k, v in want.items()}
    assert rec.wave_pairs(np.ones(50), 40.0) == [] and rec.wave_reps(np.arange(12.0), np.ones(12)) == []


def test_amplitude_gate_against_the_rule_step_by_step():
    rng = np.random.default_rng(23)
    for _ in range(200):
        v = rng.normal(size=60) * rng.choice([0.05, 1.0], 60)
        marks = sorted(rng.choice(np.arange(1, 59), int(rng.integers(0, 9)), replace=False).tolist())
        want = list(marks)
        while len(want) > 1:
            peaks = rec.stretch_peaks(v, want)
            if peaks.min() >= 0.25 * np.median(peaks[peaks > 0]):
                break
            want.pop(min(int(peaks.argmin()), len(want) - 1))
        assert rec.amplitude_gate(v, marks) == want
    assert rec.at_rest(np.array([3.0, 1, 2, -0.5, 4, 0.5]), [1, 4], 1) == [1, 3] and rec.apart([1, 2, 5, 6, 9], 4) == [1, 5, 9]


def test_signed_mean_cancels_rings():
    """A ring that swings below zero lowers the signed mean of a hill; samples that hardly move are left out."""
    rng = np.random.default_rng(29)
    for _ in range(30):
        hill = rng.uniform(0.5, 1.5) * np.sin(np.linspace(0, np.pi, int(rng.integers(20, 60))))
        ring = rng.uniform(0.2, 0.4) * hill.max() * np.sin(np.linspace(0, 2 * np.pi * rng.integers(1, 4), int(rng.integers(10, 30))))
        v = np.concatenate((np.full(5, 1e-3), hill, ring))
        loud = [x for x in v.tolist() if abs(x) >= max(0.05, 0.1 * max(map(abs, v.tolist())))]
        assert rec.active_mean(v) == pytest.approx(abs(sum(loud)) / len(loud)) and rec.active_mean(-v) == pytest.approx(rec.active_mean(v))
        assert rec.active_mean(v) < rec.active_mean(hill)
    assert rec.active_mean(np.zeros(0)) == 0


@pytest.mark.parametrize("decouple", [False, True])
def test_synthetic_set(spark, decouple):
    rows = synthetic_set(spark, n_reps=5).withColumn("a", vertical_acceleration())
    part = rows.select("t", "a").orderBy("t").toPandas()
    t, a = part["t"].to_numpy(), part["a"].to_numpy()
    assert np.abs(a - 0.8 * np.pi * np.cos(np.pi * t)).max() < 1e-9
    reps = rec.chain_segments(rows.select("recording_id", "t", "a"), how=rec.DECOUPLED if decouple else rec.Reversals()).toPandas()
    assert abs(len(reps) - 5) <= 1
    assert reps["mean_velocity"].mean() == pytest.approx(0.8 * 2 / np.pi, abs=0.05)


def test_noisy_set(spark):
    rows = synthetic_set(spark, noise_g=0.01).withColumn("a", vertical_acceleration()).select("recording_id", "t", "a")
    reps = rec.chain_segments(rows).toPandas()
    assert len(reps) >= 4 and reps["mean_velocity"].mean() == pytest.approx(0.8 * 2 / np.pi, abs=0.08)


def test_gate_drops_junk(spark):
    data = [("r", 0.0, 0.3, 0.5)] + [("r", float(k), 0.70, 0.52) for k in range(1, 11)] + [("r", 11.0, 0.7, 0.0), ("r", 12.0, 0.9, 2.0)]
    frame = spark.createDataFrame(data, "recording_id string, start double, mean_velocity double, rom double")
    got = series.gate_reps(frame).orderBy("rep").toPandas()
    assert got["rep"].tolist() == list(range(10)) and set(got["rom"]) == {0.52}


def test_strip_windows_agree_with_the_rule(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name in range(60):
        n = int(rng.integers(2, 12))
        bottom = np.cumsum(rng.integers(20, 60, n) + np.where(rng.random(n) < 0.2, 300, 0))
        amp = np.where(rng.random(n) < 0.3, 0.2, 1.0) + rng.random(n) * 0.01
        left = [(int(b), int(b) + 10, float(v), float(bottom[k + 1] - b - 10) if k + 1 < n else None) for k, (b, v) in enumerate(zip(bottom, amp))]
        rows += [(name, *x) for x in left]
        gaps, middle = np.median([x[3] for x in left[:-1]]), np.median(amp)
        for at in (-1, 0):  # from the end by size, from the start by size or by what follows
            while n >= 4 and len(left) > 3 and (left[at][2] < 0.75 * middle or at == 0 and left[0][3] is not None and left[0][3] > 2.5 * gaps):
                left.pop(at)
        want[name] = [x[:2] for x in left]
    frame = spark.createDataFrame(rows, "recording_id int, bottom long, top long, amplitude double, gap double")
    got = series.strip_ends(frame).orderBy("recording_id", "bottom").toPandas().groupby("recording_id")[["bottom", "top"]].apply(lambda g: list(zip(g["bottom"], g["top"]))).to_dict()
    assert got == want


def lifts(spec, fs=60.0, scale=0.005):
    y = np.concatenate([amp / 2 * (1 - np.cos(2 * np.pi * np.arange(int(period * fs)) / (period * fs))) for amp, period in spec])
    t = np.arange(len(y)) / fs
    return pd.DataFrame({"clip": "c", "t": t, "cx": 320.0, "cy": 400 - y / scale, "m_per_px": scale, "target_px": 90.0})


def test_trajectory_gates(spark):
    mixed = spark.createDataFrame(lifts([(0.5, 2.0)] * 3 + [(0.2, 1.0)] * 2))
    reps = traj.trajectory_reps(mixed, gate="relative").toPandas()
    assert len(reps) == 5 and (reps["flag"] == "partial_rom").sum() >= 2
    assert len(traj.trajectory_reps(mixed, gate="absolute").toPandas()) == 3


def test_plausibility_is_for_the_end_only(spark):
    base = [("c", k, 0.0, 0.5, 50.0) for k in range(1, 7)]
    tail = base + [("c", 7, 0.6, 1.3, 70.0)]
    lead = [("c", 1, 0.6, 1.3, 70.0)] + [("c", k + 1, *r[2:]) for k, r in enumerate(base, 1)]
    shape = "clip string, rep_index int, pos_start double, pos_end double, rom double"
    assert traj.plausibility_gate(spark.createDataFrame(tail, shape)).count() == 6
    assert traj.plausibility_gate(spark.createDataFrame(lead, shape)).count() == 7


def test_honesty(spark):
    t = np.arange(0, 20, 1 / 30)
    make = lambda name, x, y: pd.DataFrame({"clip": name, "t": t, "cx": x, "cy": y, "target_px": 90.0})
    wave = 100 * np.sin(2 * np.pi * t / 2)
    frame = pd.concat([make("lift", 5 * np.sin(t), wave), make("side", wave, 5 * np.sin(t)), make("still", np.sin(t), 0.5 * np.cos(3 * t)), make("drift", np.sin(t) * 0.1, 20 * t)])
    got = {r["clip"]: r for r in traj.honesty(spark.createDataFrame(frame)).collect()}
    assert got["lift"]["honest"] and got["lift"]["vertical_dominance"] > 3 and got["lift"]["periodicity"] > 0.5
    assert got["side"]["vertical_dominance"] < 0.5 and "static_track" in got["still"]["flags"] and "aperiodic" in got["drift"]["flags"]


def test_bilateral_mean_cancels_tilt(spark):
    fs, f, d = 30, 600.0, 0.45
    t = np.arange(0, 8, 1 / fs)
    y, tilt = 0.125 * (1 - np.cos(2 * np.pi * t / 2)), 0.06 * np.sin(2 * np.pi * t / 3)
    parts = []
    for side, sign in ((1, 1), (2, -1)):
        parts.append(pd.DataFrame({"clip": "c", "side": side, "t": t, "cx": 0.0, "cy": 400 - (y + sign * tilt) * f / 2.0, "target_px": d * f / 2.0, "d": np.nan, "plate_m": d, "frame_h": 800.0}))
    reps = traj.bilateral_reps(spark.createDataFrame(pd.concat(parts)), plausible=False).toPandas()
    assert len(reps) == 4 and np.abs(reps["rom"] - 25).max() < 2


def test_separated_fold(spark):
    frame = spark.createDataFrame([("r", i) for i in (1, 3, 4, 9, 10, 14)], "recording_id string, i long")
    assert sorted(r["i"] for r in rec.separated(frame, 3).collect()) == [1, 4, 9, 14]


def test_products_are_all_shifted_sums():
    rng = np.random.default_rng(24)
    for n, m in ((1, 1), (5, 9), (64, 64), (100, 7)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        assert np.allclose(s.products(a, b), np.correlate(a, b, "full"))


def test_periodicities(spark):
    t = np.arange(200)
    data = pd.concat([pd.DataFrame({"recording_id": name, "i": t[:n], "a": y[:n]}) for name, n, y in (("wave", 200, np.sin(2 * np.pi * t / 20)), ("flat", 50, np.ones(200)), ("short", 7, t * 1.0))])
    got = {r["recording_id"]: r for r in rec.periodicities(spark.createDataFrame(data)).collect()}
    assert set(got) == {"wave", "flat"} and got["wave"]["period_lag"] == 20 and got["wave"]["periodicity"] > 0.85 and got["flat"]["periodicity"] == 0


def test_cycles_find_the_number_asked_for(spark):
    wave, _ = session([(0.5, 2.0)] * 6, [0.3] * 6)
    rows = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "t": np.arange(len(wave)) / 40, "pos": -0.2 * np.cos(np.arange(len(wave)) / 40 * 2 * np.pi / 2.5), "v": 1.0}))
    found = rec.cycles(rows).count()
    assert found >= 5 and rec.cycles(rows, counts=spark.createDataFrame([("r", 3)], "recording_id string, count int")).count() == 3


def test_alignment_needs_a_bound(spark, monkeypatch):
    left = spark.createDataFrame([(k, k // 2, t / 10, float(np.sin(t / 5 + k))) for k in range(4) for t in range(60)], "recording_id int, session int, t double, y double")
    right = left.withColumnRenamed("recording_id", "clip")
    got = rec.align_all(left, right, 10.0, "session").collect()
    assert len(got) == 8 and all(r["r"] > 0.95 and r["lag"] == 0 for r in got if r["recording_id"] == r["clip"])
    assert rec.align_all(left.drop("session"), right.drop("session"), 10.0).count() == 16
    monkeypatch.setattr(rec, "MAX_PAIRS", 10)
    with pytest.raises(ValueError, match="16 pairs"):
        rec.align_all(left.drop("session"), right.drop("session"), 10.0)


def nearest_by_all(clip, gap=5, across=0.6, along=2.5, tolerance=0.32):
    """The rule of association over all tracks ever made, without a grid."""
    tracks, names = [], {}
    for frame in sorted({d[0] for d in clip}):
        free = sorted(d for d in clip if d[0] == frame)
        for n, tr in enumerate(tracks):
            if frame - tr["frame"] > gap:
                continue
            fits = [d for d in free if abs(d[1] - tr["x"]) <= across * tr["r"] and abs(d[2] - tr["y"]) <= along * tr["r"] and abs(d[3] - tr["r"]) <= tolerance * tr["r"]]
            if fits:
                d = min(fits, key=lambda d: (((d[1] - tr["x"]) / across) ** 2 + ((d[2] - tr["y"]) / along) ** 2, d))
                free.remove(d)
                names[d] = n
                tr.update(frame=frame, x=(tr["x"] + d[1]) / 2, y=d[2], r=0.7 * tr["r"] + 0.3 * d[3])
        for d in free:
            names[d] = len(tracks)
            tracks.append({"frame": frame, "x": d[1], "y": d[2], "r": d[3]})
    return names


def test_association_of_crossing_tracks(spark):
    """Tracks that cross, vanish, come back and differ in radius; the grid changes nothing."""
    rng, clips = np.random.default_rng(31), {}
    for name in range(30):
        found = set()
        for _ in range(int(rng.integers(1, 9))):
            x, y, r, vx, vy = rng.uniform(0, 300), rng.uniform(-200, 200), rng.uniform(15, 60), rng.normal(0, 4), rng.normal(0, 15)
            for frame in range(int(rng.integers(0, 10)), 40):
                if rng.random() < 0.8:
                    found.add((frame, round(x + vx * frame + rng.normal(0, 3), 3), round(y + vy * frame + rng.normal(0, 5), 3), round(r * rng.uniform(0.85, 1.15), 3)))
        clips[name] = sorted(found)
    frame = spark.createDataFrame([(n, *d) for n, c in clips.items() for d in c], "clip int, frame int, cx double, cy double, r double")
    got = {}
    for r in traj.link_tracks(frame.repartition(5)).collect():
        got.setdefault(r.clip, {})[(r.frame, r.cx, r.cy, r.r)] = r.track
    assert got == {n: nearest_by_all(c) for n, c in clips.items() if c}


def test_stale_tracks_are_forgotten():
    linker = traj.Linker()
    for k in range(500):
        linker.link(10 * k, [(1000.0 * k, 0.0, 10.0)])
    assert linker.made == 500 and len(linker.live) == 1


def test_the_track_that_swings_is_counted(spark):
    """Beside a still plate and one that drifts by, at other radii, the lifted one is chosen and its reps counted."""
    from barlake.operators import estimates

    fps, rows = 15.0, []
    for clip, n in ((1, 4), (2, 7)):
        for k in range(int(n * 2.0 * fps)):
            t = k / fps
            lifted = (320.0 + float(np.sin(k)), 400 - 60 * (1 - float(np.cos(np.pi * t))), 45.0)
            rows += [(clip, k, t, *d) for d in (lifted, (520.0, 380 + 0.3 * float(np.sin(7.0 * k)), 44.0), (-200 + 12.0 * k, 300.0, 20.0)) if k % 11 or d is not lifted]
    frame = spark.createDataFrame(rows, "clip int, frame int, t double, cx double, cy double, r double")
    reps = estimates.auto_counts(frame).groupBy("clip").count().collect()
    assert {r.clip: r["count"] for r in reps} == {1: 4, 2: 7}
    assert estimates.auto_counts(frame.where("frame < 5")).isEmpty() and estimates.auto_counts(frame.limit(0)).isEmpty()


def test_ends_that_hardly_meet_give_no_reps(spark):
    side = lambda clip, k, first, n: [(clip, k, (first + i) / 30, 320.0, 400 - 50 * (1 - float(np.cos(2 * np.pi * i / 60))), 90.0, None, 0.45, 800.0) for i in range(n)]
    rows = side(1, 1, 0, 8) + side(1, 2, 0, 60) + side(2, 1, 0, 200) + side(2, 2, 0, 200) + side(3, 1, 0, 90) + side(4, 1, 0, 60) + side(4, 2, 200, 60)
    frame = spark.createDataFrame(rows, "clip int, side int, t double, cx double, cy double, target_px double, d double, plate_m double, frame_h double")
    assert {r.clip for r in traj.bilateral_reps(frame).collect()} == {2}
    assert {r.clip: r.usable for r in traj.bilateral_overlap(frame).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_prominences_and_neighbours_against_plain_search():
    rng = np.random.default_rng(33)
    for t in range(150):
        x = np.round(rng.normal(size=int(rng.integers(3, 120))), 1) if t % 2 else np.cumsum(rng.normal(size=80))
        for distance in (1, 3, 7):
            found = s.peaks(x, distance)
            assert s.prominences(x, found).tolist() == pytest.approx([s.prominence_of(x, p) for p in found])
        at = np.sort(rng.choice(200, 40, replace=False))
        height, gone = np.round(rng.normal(size=40), 1), np.zeros(40, bool)
        for k in np.argsort(height, kind="stable")[::-1]:
            if not gone[k]:
                gone |= (np.abs(at - at[k]) < 9) & (np.arange(40) != k)
        assert s.suppressed(at, height, 9).tolist() == gone.tolist()
    long = np.sin(np.arange(300_000) / 7) + rng.normal(size=300_000) * 0.1
    assert len(s.peaks(long, 20, 1.0)) == pytest.approx(300_000 / (14 * np.pi), rel=0.02)


def test_filter_over_blocks_equals_one_task(spark):
    """Recordings split over many tasks, of all lengths, with a block that ends at a recording's end."""
    from barlake.operators import filters

    rng = np.random.default_rng(34)
    waves = {k: np.cumsum(rng.normal(size=n)) for k, n in enumerate((1, 2, 5, 10, 46, 64, 500, 1003))}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"recording_id": k, "i": np.arange(len(w)), "a": w}) for k, w in waves.items()])).repartition(8)
    for hz, kind in ((0.5, "high"), (3.0, "low")):
        got = filters.zero_phase(rows, hz, 50.0, kind, block=64).orderBy("recording_id", "i").toPandas().groupby("recording_id")["a"].apply(list).to_dict()
        for k, w in waves.items():
            assert got[k] == pytest.approx(s.zero_phase(w, hz, 50.0, kind).tolist(), abs=1e-9)
    assert filters.zero_phase(rows.limit(0), 0.5, 50.0, "high").isEmpty()
