import datetime as dt

import pytest

from isotherm.functions.numbers import quantiles
from isotherm.operators import month, normals, outlook, series, year
from isotherm.operators.clean import clean
from tests.conftest import days, temps

D = dt.date


def test_yearly_means_full_years_and_smoothing(obs):
    rows = days(D(2000, 1, 1), D(2003, 12, 31), lambda d: None if d.year == 2002 and d.month > 1 else temps(d.year - 2000))
    out = series.yearly_series(clean(obs(rows))).orderBy("jahr").collect()
    assert [(r.jahr, r.wert) for r in out] == [(2000, 0.0), (2001, 1.0), (2003, 3.0)]
    assert [r.glatt for r in out] == [pytest.approx(4 / 3)] * 3


def test_month_needs_ninety_percent(obs):
    rows = days(D(2000, 1, 1), D(2000, 2, 29), lambda d: temps(10) if d.day > 5 or d.month == 1 else None)
    assert [r.wert for r in series.monthly_series(clean(obs(rows))).collect()] == [10.0]


@pytest.fixture(scope="module")
def long_series(obs):
    return clean(obs(days(D(1991, 1, 1), D(2023, 3, 10), lambda d: temps({2021: 12, 2022: 8}.get(d.year, 10))))).cache()


def test_year_to_date_and_normals(long_series):
    r = year.ytd_rank(long_series).collect()[0]
    assert (r.jahr, r.letzter, r.laufend, r.von) == (2023, D(2023, 3, 10), True, 33)
    assert 2 <= r.platz < 33
    usual = {x.k: x for x in normals.day_normals(long_series).collect()}
    assert len(usual) == 366
    assert (usual[60].tmk, usual[60].txk, usual[60].tnk) == pytest.approx((10.0, 15.0, 5.0))
    assert normals.normal_years(long_series).collect()[0].normal_jahre == 30
    last = year.year_days(long_series).collect()[-1]
    assert (last.k, last.tmk, last.txk, last.tnk) == (69, 10.0, 15.0, 5.0)
    past = year.ytd_rank(long_series, 2021).collect()[0]
    assert (past.m, past.tage, past.platz, past.von) == (12.0, 365, 1, 32)
    first = year.months_vs_normal(long_series, 2021).orderBy("monat").collect()[0]
    assert (first.monat, first.m, first.tage, first.normal) == (1, 12.0, 31, 10.0)


@pytest.fixture(scope="module")
def thirty(obs):
    def mean(d):
        return 12 if d.year == 2026 else 10 if d.month <= 10 else d.year - 1995
    return clean(obs(days(D(1996, 1, 1), D(2026, 10, 31), lambda d: temps(mean(d), 3)))).cache()


TODAY = D(2026, 11, 1)


def test_outlook_from_the_rest_of_earlier_years(thirty):
    p = outlook.year_forecast(thirty, TODAY).collect()[0]
    assert (p.vergleichsjahre, p.jahre_von, p.jahre_bis, p.rest_tage, p.von) == (30, 1996, 2025, 61, 31)
    for value, rest in ((p.tief, 3.9), (p.mitte, 15.5), (p.hoch, 27.1)):
        assert value == pytest.approx((12.0 * 304 + rest * 61) / 365)
    assert p.platz_hoch <= p.platz <= p.platz_tief
    assert outlook.year_forecast(thirty, D(2027, 3, 1)).count() == 0


def test_trajectory_ends_at_the_outlook(thirty):
    p = outlook.year_forecast(thirty, TODAY).collect()[0]
    way = outlook.forecast_trajectory(thirty, TODAY).orderBy("datum").collect()
    assert way[-1].datum == D(2026, 10, 31) and len(way) == 304
    assert (way[-1].tief, way[-1].mitte, way[-1].hoch) == pytest.approx((p.tief, p.mitte, p.hoch))


def test_rankings(thirty):
    now = year.ranking(thirty, "heute").orderBy("platz").collect()
    assert now[0].jahr == 2026 and len(now) == 31
    without = year.ranking(thirty, "jahr").orderBy("platz").collect()
    assert without[0].jahr == 2025 and 2026 not in [r.jahr for r in without]
    with_it = year.ranking(thirty, "jahr", forecast=outlook.year_forecast(thirty, TODAY)).orderBy("platz").collect()
    row = next(r for r in with_it if r.jahr == 2026)
    assert row.prognose and row.tief < row.m < row.hoch
    assert [r.platz for r in with_it] == list(range(1, 32))


def test_month_with_sum_and_normal(obs):
    more = {"fx": 7.9, "fm": 2.9, "rsk": 0.4, "rskf": 6}
    c = clean(obs(days(D(1991, 1, 1), D(2021, 1, 10), lambda d: {**temps(10), **more})))
    rows = month.month_days(c).collect()
    assert len(rows) == 10 and (rows[0].jahr, rows[0].monat) == (2021, 1)
    assert (rows[0].fx, rows[0].fm) == (pytest.approx(28.44), pytest.approx(10.44))
    assert rows[0].rskf == 6 and rows[0].abw == pytest.approx(0.0)
    total = month.month_summary(c).collect()[0]
    assert (total.bis_tag, total.rsk, total.tmk, total.n_tmk) == (10, pytest.approx(4.0), 10.0, 10)
    usual = month.month_normal(c).collect()[0]
    assert (usual.rsk, usual.normal_jahre) == (pytest.approx(4.0), 30)


def test_quantile_of_one_to_thirty(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 31)], "k int, v double")
    assert quantiles(df, ["k"], "v", (0.1, 0.5, 0.9)).collect()[0].q == pytest.approx([3.9, 15.5, 27.1])
