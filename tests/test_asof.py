"""As-of joins against a loop."""

import datetime as dt
import random

import pytest

from wayfare.operators.asof import as_of

START = dt.datetime(2024, 1, 1)


def tables():
    r = random.Random(8)
    at = lambda: START + dt.timedelta(minutes=r.randint(0, 4000))
    left = [(k, r.choice(["a", "b", "c", None]), at(), k) for k in range(200)] + [(900, "a", None, 1), (901, "none", START, 1), (902, "a", START, 1)]
    right = [(r.choice(["a", "a", "b", None]), at(), k) for k in range(80)] + [("a", None, 900), ("b", START + dt.timedelta(minutes=2000), 901), ("b", START + dt.timedelta(minutes=2000), 902)]
    return left, right


@pytest.mark.parametrize(("bucket", "tolerance"), [(3600.0, None), (86_400.0, None), (10.0**9, None), (3600.0, 7200.0)])
def test_as_of(spark, bucket, tolerance):
    left, right = tables()
    a = spark.createDataFrame(left, "id long, user string, time timestamp, n long").repartition(3)
    b = spark.createDataFrame(right, "who string, since timestamp, n long").repartition(2)
    found = as_of(a, b, "user", "time", ["n", "since"], "who", "since", ["n"], bucket, tolerance)
    assert found.columns == ["id", "user", "time", "n", "n_right", "since"]
    got = {x.id: x.n_right for x in found.collect()}
    for k, user, time, _ in left:
        known = [(t, n) for w, t, n in right if w == user and w is not None and t is not None and time is not None and t <= time]
        best = max(known, default=None)
        if best and tolerance is not None and (time - best[0]).total_seconds() > tolerance:
            best = None
        assert got[k] == (best[1] if best else None), (k, user, time)
    assert len(got) == len(left) and as_of(a, b.limit(0), "user", "time", ["n"], "who", "since").where("n_right is not null").count() == 0
    assert as_of(a.limit(0), b, "user", "time", ["n"], "who", "since").collect() == []
