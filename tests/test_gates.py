import numpy as np
import pytest
from pyspark.sql import functions as F

from framelathe.config import SignalGates
from framelathe.operators.calibrate import Calibration, calibrate
from framelathe.operators.gates import frame_scores, signal_gates, summary
from framelathe.operators.quantiles import exact_percentiles
from framelathe.sources.frames import Frames, from_arrays

UNIT = Calibration("u", 1, 99.9, [0.0] * 3, [1.0] * 3, [0.0], [1.0], 6.0, 5.0)


def frames_of(spark, episodes, shuffle=False):
    """episodes: {ep: (state T x 2, action T x 1, timestamps)}"""
    rows = []
    for e, (s, a, t) in episodes.items():
        for i in range(len(a)):
            rows.append(([None if x is None else float(x) for x in s[i]], [float(x) for x in a[i]], float(t[i]), e, i))
    if shuffle:
        rows.reverse()
    df = spark.createDataFrame(rows, "`observation.state` array<float>, action array<float>, timestamp float, episode_index bigint, frame_index bigint")
    return from_arrays(df, 2, 1)


def sine(n, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n)
    return np.stack([np.sin(0.03 * t + r.uniform()), np.cos(0.02 * t)], 1), np.sin(0.05 * t)[:, None], t / 10


def jerk(x):
    return np.diff(x, n=3, axis=0) if len(x) > 3 else np.zeros((0, x.shape[1]))


def scores(x, c, s):
    s = np.where(np.array(s) == 0, np.nan, s)
    with np.errstate(invalid="ignore"):
        z = np.abs((x - np.array(c)) / s)
    return np.where(np.isfinite(z), z, 0).max(1) if len(x) else np.zeros(0)


def expected(eps, c, fps):
    out = {}
    for e, (s, a, t) in eps.items():
        s, a = np.float32(s).astype(float), np.float32(a).astype(float)
        x = np.hstack([s, a])
        js, ac = scores(jerk(x), c.jerk_center, c.jerk_scale), scores(a, c.action_center, c.action_scale)
        n, t = len(a), np.float32(t).astype(float)
        d = float(t[-1] - t[0]) if n > 1 else 0.0
        miss = 0.0
        if fps and n > 1 and d > 0:
            want = int(round(d * fps)) + 1
            miss = max(0.0, (want - n) / want)
        miss = max(miss, np.isnan(x).any(1).sum() / n)
        out[e] = (n, round((js > c.jerk_score_threshold).mean() if len(js) else 0.0, 6), round((ac > c.action_score_threshold).mean(), 6), round(miss, 6))
    return out


def got(df):
    return {r.ep: (r.n_frames, r.jerk_anomalous_ratio, r.action_anomalous_ratio, r.missing_frame_ratio) for r in df.collect()}


@pytest.fixture()
def episodes():
    eps = {e: sine(80 + e, e) for e in range(6)}
    eps[6] = sine(60, 6)
    eps[6][0][30:36, 0] += 50 * np.array([1, -1, 1, -1, 1, -1])
    eps[7] = sine(50, 7)
    eps[7][1][10:13] = 500
    eps[8] = tuple(x[::4] for x in sine(60, 8))
    eps[9] = sine(2, 9)
    eps[10] = sine(3, 10)
    eps[11] = sine(40, 11)
    eps[11][0][5, 1] = np.nan
    eps[12] = sine(40, 12)
    eps[12][1][7] = np.inf
    return eps


def test_verdicts_equal_an_independent_computation(spark, episodes):
    clean = {e: x for e, x in episodes.items() if e < 6}
    c = calibrate(frames_of(spark, clean), "clean")
    js = np.vstack([jerk(np.hstack([np.float32(s).astype(float), np.float32(a).astype(float)])) for s, a, _ in clean.values()])
    med = np.median(js, axis=0)
    assert np.allclose(c.jerk_center, np.round(med, 6), atol=2e-6)
    assert np.allclose(c.jerk_scale, np.round(np.median(np.abs(js - med), axis=0) * 1.4826, 6), atol=2e-6)
    df = signal_gates(frames_of(spark, episodes), c, SignalGates(max_anomalous_frame_ratio=0.05), 10)
    assert got(df) == expected(episodes, c, 10)
    verdict = {r.ep: (r.passed, list(r.reasons)) for r in df.collect()}
    assert sum(verdict[e][0] for e in range(6)) >= 3 and not verdict[6][0] and not verdict[7][0] and not verdict[8][0] and not verdict[11][0]
    assert verdict[6][1][0].startswith("jerk-anomalous frames ") and verdict[6][1][0].endswith(" > 0.05")
    assert any(r.startswith("action-anomalous frames") for r in verdict[7][1])
    assert verdict[8][1][-1].startswith("missing-frame ratio")
    assert verdict[9][0] and verdict[10][0]
    total = summary(df).first()
    assert total.total == 13 and total.passed == sum(v[0] for v in verdict.values())


def test_row_order_does_not_matter(spark, episodes):
    a, b = (got(signal_gates(frames_of(spark, episodes, shuffle=s), UNIT, fps=10)) for s in (False, True))
    assert a == b


def test_infinity_scores_zero_and_is_not_missing(spark, episodes):
    r = got(signal_gates(frames_of(spark, {12: episodes[12]}), UNIT))[12]
    assert r[2] == 0 and r[3] == 0


def test_null_elements_are_nan(spark):
    s, a, t = sine(20)
    s = s.tolist()
    s[4][1] = None
    assert got(signal_gates(frames_of(spark, {0: (s, a, t)}), UNIT))[0][3] == 0.05


def test_nan_in_calibration_disables_the_dimension(spark, episodes):
    c = calibrate(frames_of(spark, {11: episodes[11], 0: episodes[0]}), "nan")
    assert np.isnan(c.jerk_center[1]) and not np.isnan(c.jerk_center[0])
    frame_scores(frames_of(spark, {0: episodes[0]}), c).count()


def test_wrong_width_is_refused(spark, episodes):
    with pytest.raises(ValueError):
        frame_scores(frames_of(spark, {0: episodes[0]}), Calibration("x", 1, 99.9, [0.0] * 4, [1.0] * 4, [0.0], [1.0]))


def test_nothing_to_calibrate_on(spark):
    with pytest.raises(ValueError):
        calibrate(frames_of(spark, {0: sine(2)}), "short")


def test_no_episodes(spark):
    df = signal_gates(frames_of(spark, {0: sine(5)}), UNIT).filter("ep < 0")
    assert tuple(summary(df).first()) == (0, 0, 0, 0.0)


def test_percentiles_narrowed_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 2.0, 1e12, -1e-9], 500), rng.pareto(0.3, 2000) * rng.choice([-1, 1], 2000)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ps = [0.0, 0.1, 0.5, 0.999, 1.0]
        want = np.percentile(values, [100 * p for p in ps])
        for one_pass in (50, 10**6):
            found = exact_percentiles(df, [(F.col("v"), p) for p in ps], len(values), one_pass)
            assert np.allclose(found, want, rtol=1e-12)


def test_action_alone_without_state(spark):
    df = spark.createDataFrame([([float(i % 3)], float(i), 0) for i in range(9)], "action array<float>, timestamp float, episode_index bigint")
    f = from_arrays(df, 7, 1)
    assert isinstance(f, Frames) and f.state == () and f.order == ("o_timestamp",)


def test_long_episodes_are_split_without_a_trace(spark):
    from framelathe.operators.jerk import with_jerk

    rng = np.random.default_rng(5)
    rows = [(e, float(t // 3), t % 3, float(rng.normal()), float(rng.normal())) for e, n in ((1, 700), (2, 30), (3, 410)) for t in range(n)]
    df = spark.createDataFrame(rows, "ep bigint, o1 double, o2 bigint, s0 double, a0 double").repartition(4)
    f = Frames(df, "ep", ("o1", "o2"), ("s0",), ("a0",))
    want = sorted(map(tuple, with_jerk(f).df.collect()), key=str)
    for segment in (50, 97, 1000):
        got = with_jerk(f, hot_rows=100, segment_rows=segment).df
        assert sorted(map(tuple, got.select("ep", "o1", "o2", "s0", "a0", "rn", "j_s0", "j_a0").collect()), key=str) == want
    tied = f.with_df(df.withColumn("o2", F.col("o1").cast("bigint") * 10 + F.col("o2")).withColumn("o1", F.lit(1.0)))
    assert with_jerk(tied, hot_rows=100, segment_rows=50).df.filter("j_s0 is null").count() == 9
