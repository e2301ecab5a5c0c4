"""The ten-best state against records and new records over all days."""

import datetime as dt
import random

import pytest

from isotherm.operators import national as N, records as R
from tests.test_rollup import listed, rows

D = dt.date


@pytest.fixture(scope="module")
def c(spark, obs):
    rng = random.Random(7)
    # coarse values, so that many days share one
    out = obs(rows(rng, 1, D(1990, 1, 1), 3700, 0), 1).unionByName(obs(rows(rng, 2, D(1998, 6, 1), 700, 0), 2)).unionByName(obs(rows(rng, 3, D(1999, 9, 1), 200, 0), 3))
    return out.cache()


def test_merged_is_recomputed(c):
    first = N.best_state(c, D(1995, 3, 3))
    step = N.advance_state(N.advance_state(first, c, D(1998, 12, 31)), c, D(1999, 10, 10))
    assert listed(step) == listed(N.best_state(c, D(1999, 10, 10)))
    held = {(r.station, r.kat): [(k.key, k.datum) for k in r.beste] for r in step.collect()}
    for (station, kat), best in held.items():
        days = [(r.key, r.datum) for r in R.by_category(c).where(f"station = {station} and kat = {kat} and datum <= '1999-10-10'").collect()] if station == 2 else None
        assert len(best) <= 10 and (days is None or best == sorted(days)[:10])


@pytest.mark.parametrize("bis,days", [(D(1992, 1, 1), 365), (D(1999, 1, 1), 365), (D(1996, 5, 5), 1000), (D(1980, 1, 1), 100)])
def test_new_records_from_state(c, bis, days):
    assert listed(N.new_records_from_state(N.best_state(c, bis), c, days)) == listed(N.new_records(c, days))
    with pytest.raises(ValueError, match="after the window begins"):
        N.new_records_from_state(N.best_state(c, D(2000, 1, 1)), c, 365)


def test_nothing(c):
    none = c.limit(0)
    assert N.new_records_from_state(N.best_state(none, D(1990, 1, 1)), none).count() == 0
    assert N.new_records_from_state(N.best_state(none, D(1990, 1, 1)), c, 365).count() == N.new_records(c, 365).count()
