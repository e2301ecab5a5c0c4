import datetime as dt

from isotherm.operators.clean import clean, jumps, rule_audit
from isotherm.operators.series import daily_series, with_gaps
from tests.conftest import temps

D = dt.date


def three(df):
    return [(r.datum, r.tmk, r.txk, r.tnk) for r in df.orderBy("datum").collect()]


def t(m, x, n, qn=10):
    return {"tmk": m, "txk": x, "tnk": n, "qn": qn}


def test_limits_take_single_values(obs):
    raw = obs([(D(2000, 1, 1), t(10.0, 55.0, 5.0)), (D(2000, 1, 2), t(-50.0, 2.0, -3.0)),
               (D(2000, 1, 3), t(10.0, 15.0, 5.0)), (D(2000, 1, 4), t(50.0, 50.0, -45.0))])
    assert three(clean(raw)) == [
        (D(2000, 1, 1), 10.0, None, 5.0), (D(2000, 1, 2), None, 2.0, -3.0),
        (D(2000, 1, 3), 10.0, 15.0, 5.0), (D(2000, 1, 4), 50.0, 50.0, -45.0)]


def test_contradictions(obs):
    raw = obs([(D(2000, 1, 1), t(5.0, 3.0, 4.0)), (D(2000, 1, 2), t(9.0, 8.0, 2.0)),
               (D(2000, 1, 3), t(1.0, 8.0, 2.0)), (D(2000, 1, 4), t(1.0, None, 2.0))])
    assert three(clean(raw)) == [
        (D(2000, 1, 1), None, None, None), (D(2000, 1, 2), None, 8.0, 2.0),
        (D(2000, 1, 3), None, 8.0, 2.0), (D(2000, 1, 4), None, None, 2.0)]


def test_quality_levels(obs):
    raw = obs([(D(2000, 1, i), t(1.0, 2.0, 0.0, q)) for i, q in ((1, 1), (2, 5), (3, 10), (4, None))])

    def n(level):
        return clean(raw, level).where("tmk IS NOT NULL").count()
    assert [n("alle"), n("ab5"), n("nur10"), n("unsinn")] == [4, 2, 1, 4]


def test_other_measures_and_wind_level(obs):
    good = {"fx": 20.0, "fm": 5.0, "rsk": 3.2, "rskf": 6, "sdk": 4.5, "shk": 2.0, "nm": 6.0, "vpm": 9.7,
            "pm": 1000.0, "upm": 80.0, "tgk": 1.0}
    raw = obs([
        (D(2000, 1, 1), good),
        (D(2000, 1, 2), {**good, "fx": 70.0, "rskf": 5, "sdk": 17.0, "upm": 101.0}),
        (D(2000, 1, 3), {**good, "fx": 4.0, "rsk": None, "rskf": 7, "shk": 900.0, "nm": 9.0,
                         "vpm": 130.0, "pm": 400.0, "tgk": -60.0}),
        (D(2000, 1, 4), {**good, "qn3": 1})])
    names = ["fx", "fm", "rsk", "rskf", "sdk", "shk", "nm", "vpm", "pm", "upm", "tgk"]
    rows = [tuple(r[n] for n in names) for r in clean(raw).orderBy("datum").collect()]
    assert rows[0] == tuple(good[n] for n in names)
    assert rows[1] == (None, 5.0, 3.2, None, None, 2.0, 6.0, 9.7, 1000.0, None, 1.0)
    assert rows[2] == (4.0, None, None, 7, 4.5, None, None, None, None, 80.0, None)
    strict = clean(raw, "nur10").orderBy("datum").collect()[3]
    assert (strict.fx, strict.rsk) == (None, 3.2)


def test_audit_counts_every_rule(obs):
    raw = obs([(D(2000, 1, 1), t(10.0, 55.0, 5.0)), (D(2000, 1, 2), t(5.0, 3.0, 4.0)),
               (D(2000, 1, 3), t(9.0, 8.0, 2.0)), (D(2000, 1, 4), t(-10.0, -8.0, -12.0)),
               (D(2000, 1, 5), t(8.0, 10.0, 6.0)), (D(2000, 1, 6), t(8.0, 10.0, 6.0, 1))])
    row = rule_audit(raw).collect()[0]
    assert (row.tage, row.qn_weg, row.grenze_weg, row.max_unter_min, row.mittel_ausserhalb, row.spruenge) \
        == (6, 0, 1, 1, 1, 1)
    assert rule_audit(raw, "nur10").collect()[0].qn_weg == 1


def test_jump_is_marked_and_gap_breaks_the_line(obs):
    c = clean(obs([(D(1893, 1, 14), t(-2.0, 0.0, -4.0)), (D(1893, 1, 15), t(-19.0, -15.0, -22.0)),
                   (D(1893, 1, 17), t(0.0, 1.0, -1.0))]))
    assert [(r.datum, r.wert, r.vorher) for r in jumps(c).collect()] == [(D(1893, 1, 15), -19.0, -2.0)]
    line = with_gaps(daily_series(c), 86400).orderBy("t").collect()
    assert [r.wert for r in line] == [-2.0, -19.0, None, 0.0]
    assert line[2].t - line[1].t == 86400


def test_jump_over_the_turn_of_the_year(obs):
    c = clean(obs([(D(1999, 12, 31), temps(0)), (D(2000, 1, 1), temps(16)), (D(2000, 1, 2), temps(30))]))
    assert [r.datum for r in jumps(c).collect()] == [D(2000, 1, 1)]


def test_gap_between_blocks_is_found_once(obs):
    c = clean(obs([(D(1990, 1, 1), temps(1)), (D(1995, 6, 1), temps(2)), (D(2000, 1, 1), temps(3))]))
    line = with_gaps(daily_series(c), 86400).orderBy("t").collect()
    assert [r.wert for r in line] == [1.0, None, 2.0, None, 3.0]
