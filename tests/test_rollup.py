"""The versioned store: days and summary after refreshes, and after a writer that dies."""

import datetime as dt
import random

import pytest

from isotherm.operators import records as R, series as S
from isotherm.operators.clean import clean
from isotherm.operators.ingest import behind_history
from isotherm.plans import rollup

D = dt.date


def rows(rng, station, first, n, quelle):
    return [(first + dt.timedelta(days=i), {"tmk": (t := rng.randint(-100, 250) / 10), "txk": t + rng.randint(0, 9), "tnk": t - rng.randint(0, 9), "quelle": quelle,
                                           "rsk": None if rng.random() < .3 else rng.randint(0, 50) / 10}) for i in range(n) if rng.random() > .02]


def listed(df, digits=9):
    def v(x):
        return round(x, digits) if isinstance(x, float) else x
    names = sorted(df.columns)
    return sorted((tuple(v(r[c]) for c in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def series(spark, obs):
    rng = random.Random(2)
    hist = obs(rows(rng, 1, D(2001, 1, 1), 800, 0), 1).unionByName(obs(rows(rng, 2, D(2002, 3, 1), 500, 0), 2)).unionByName(obs(rows(rng, 4, D(2002, 1, 1), 60, 0), 4))
    recent = obs(rows(rng, 1, D(2003, 2, 1), 120, 1), 1).unionByName(obs(rows(rng, 3, D(2003, 1, 5), 60, 1), 3))
    second = obs(rows(rng, 1, D(2003, 3, 1), 40, 1), 1).unionByName(obs(rows(rng, 5, D(2003, 1, 1), 9, 1), 5))
    third = obs(rows(rng, 3, D(2003, 1, 1), 80, 1), 3)
    return hist, recent, second, third


def whole(hist, recent):
    ends = hist.groupBy("station").agg({"datum": "max"}).withColumnRenamed("max(datum)", "_ende")
    return hist.unionByName(behind_history(recent, ends))


def agrees(spark, path, want, answers=False):
    days, months, c = rollup.read_days(spark, path), rollup.read_months(spark, path), clean(want)
    assert listed(days) == listed(want)
    assert listed(months) == listed(rollup.monthly_summary(c))
    if not answers:
        return
    assert listed(rollup.yearly_means(months, min_days=50)) == listed(S.yearly_means(c, min_days=50))
    assert listed(rollup.extremes(months)) == listed(R.extremes(c))
    assert listed(rollup.monthly_series(months, "txk", 0.5)) == listed(S.monthly_series(c, "txk", 0.5))
    assert listed(rollup.coverage(months)) == listed(S.coverage(c).select("station", "tage"))


def test_two_refreshes_and_a_dead_writer(spark, series, tmp_path, monkeypatch):
    hist, recent, second, third = series
    path = str(tmp_path / "store")
    rollup.build_rollup_store(spark, hist.unionByName(recent), path, 4)
    agrees(spark, path, whole(hist, recent))

    after = recent.join(second.select("station").distinct(), "station", "left_anti").select(*recent.columns).unionByName(second)
    with monkeypatch.context() as m:
        def dies(*_):
            raise RuntimeError("killed between data and journal")
        m.setattr(rollup, "_commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            rollup.refresh_rollup_store(spark, second, path, 4)
    agrees(spark, path, whole(hist, recent))
    rollup.refresh_rollup_store(spark, second, path, 4)
    agrees(spark, path, whole(hist, after))
    rollup.refresh_rollup_store(spark, second, path, 4)
    agrees(spark, path, whole(hist, after))
    last = after.join(third.select("station").distinct(), "station", "left_anti").select(*recent.columns).unionByName(third)
    rollup.refresh_rollup_store(spark, third, path, 4)
    agrees(spark, path, whole(hist, last), answers=True)
    rollup.refresh_rollup_store(spark, third.limit(0), path, 4)
    agrees(spark, path, whole(hist, last))


def test_the_summary_answers_without_days(spark, series, tmp_path):
    path = str(tmp_path / "store")
    rollup.build_rollup_store(spark, series[0].unionByName(series[1]), path, 4)
    for df in (rollup.yearly_means(rollup.read_months(spark, path)), rollup.extremes(rollup.read_months(spark, path))):
        assert all("/monate/" in f for f in df.inputFiles())
