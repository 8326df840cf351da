"""Exact percentiles by refined histograms against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfare.operators import quantiles, reports

SHARES = [0.0, 0.25, 0.5, 0.95, 1.0]


def plain(values, q):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    if not known:
        return None
    at = q * (len(known) - 1)
    low, high = known[math.floor(at)], known[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def values():
    r = random.Random(4)
    groups = {
        "plain": [r.gauss(0, 5) for _ in range(700)], "ties": [float(r.randint(0, 3)) for _ in range(500)], "one": [2.5], "none": [None, None],
        "same": [7.0] * 300, "skewed": [10.0 ** r.randint(-30, 30) for _ in range(400)], None: [float(k) for k in range(101)],
        "odd": [float("nan"), None, 1.0, 2.0, float("nan")], "ends": [float("-inf"), *[float(k) for k in range(50)], float("inf"), float("inf")],
        "zeros": [-0.0, 0.0, 1e-300, -1e-300, 5e-324] * 20,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    return groups, rows


@pytest.mark.parametrize(("small", "bins", "most"), [(0, 4, 3), (0, 1024, 1000), (10_000, 1024, 1000)])
def test_quantiles_of_groups(spark, monkeypatch, small, bins, most):
    monkeypatch.setattr(quantiles, "BINS", bins)
    groups, rows = values()
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    found = quantiles.with_quantiles(df, "v", ["k"], SHARES, F.count(F.lit(1)).alias("n"), small=small, most=most).collect()
    assert {r.k: r.n for r in found} == {k: len(v) for k, v in groups.items()}
    for row in found:
        for p, q in zip(row.p or [None] * len(SHARES), SHARES, strict=True):
            expected = plain(groups[row.k], q)
            assert (p is None and expected is None) or p == pytest.approx(expected, rel=1e-12), (row.k, q)


@pytest.mark.parametrize("small", [0, 100])
def test_quantiles_without_keys(spark, small):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    (row,) = quantiles.with_quantiles(df, "v", [], [0.5], F.count(F.lit(1)).alias("n"), small=small).collect()
    assert row.n == 10 and row.p == [5.5]
    (row,) = quantiles.with_quantiles(df.limit(0), "v", [], [0.5], F.count(F.lit(1)).alias("n"), small=small).collect()
    assert row.n == 0 and (row.p is None or row.p == [None])


def test_no_bin_is_larger_than_its_bound(spark, monkeypatch):
    """Values of very different sizes: passes go on until every bin is small or of one value."""
    sizes, keep = [], quantiles.kept
    monkeypatch.setattr(quantiles, "BINS", 8)

    def watched(df, name):
        out = keep(df, name)
        if name == "quantile-bins":
            sizes.append(out.where("lo < hi").agg(F.max("c")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "kept", watched)
    df = spark.range(5000).select(F.exp(F.rand(1) * 30).alias("v"), F.lit("g").alias("k"))
    quantiles.with_quantiles(df, "v", ["k"], [0.5], small=0, most=20).collect()
    assert len(sizes) > 2 and sizes[-1] <= 20 and sizes == sorted(sizes, reverse=True)


def test_reports_do_not_depend_on_the_way(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 4).cast("string").alias("Category"), (F.rand(2) * 50).alias("DelayHours"))
    first = sorted(map(tuple, reports.delay_distribution(df).drop("mean").collect())), reports.delay_summary(df).select("median", "n_negative").first()
    monkeypatch.setattr(quantiles, "SMALL", 10)
    monkeypatch.setattr(quantiles, "BIN", 10)
    assert (sorted(map(tuple, reports.delay_distribution(df).drop("mean").collect())), reports.delay_summary(df).select("median", "n_negative").first()) == first
