"""Bins of a value and their allocation against numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import optimize as O


def made(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    v, p, s = rng.normal(size=n) * 3 + 1, rng.random(n), rng.random(n) ** 3
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(v, p, s, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "value double, pi double, var double").repartition(4)
    return v, p, s, df


@pytest.mark.parametrize("method", ["uniform", "log_uniform", "equal"])
def test_bins(spark, method):
    v, p, s, df = made(spark)
    c = O.value_centres(df, 7, method, 500)
    assert len(c) == 7 and c == sorted(c) and v.min() <= c[0] and c[-1] <= v.max()
    own = np.abs(v[:, None] - np.array(c)).argmin(axis=1)
    got = {r.bin: r for r in O.value_bins(df, c).collect()}
    assert got.keys() == set(own.tolist())
    alloc = {b: np.sqrt(p[own == b].sum() * (p * s)[own == b].sum()) for b in got}
    for b, r in got.items():
        assert r.n == (own == b).sum()
        assert [r.weight, r.variance, r.share] == pytest.approx([p[own == b].sum(), v[own == b].var(), alloc[b] / sum(alloc.values())])


def test_equal_bins_have_like_shares(spark):
    """Of many bins none takes much more than its part, while equal widths leave most to the middle ones."""
    _, _, _, df = made(spark, 2, 4000)
    most = lambda method: max(r.share for r in O.value_bins(df, O.value_centres(df, 10, method)).collect())
    assert most("equal") < 0.2 < 0.25 < most("uniform")


def test_log_widths_grow(spark):
    _, _, _, df = made(spark)
    c = np.array(O.value_centres(df, 6, "log_uniform"))
    widths = np.diff(c)
    assert widths[1:] / widths[:-1] == pytest.approx(np.full(4, widths[1] / widths[0])) and widths[1] > widths[0]
    with pytest.raises(ValueError):
        O.value_centres(df.where("value > 0"), 6, "log_uniform")


def test_few_values(spark):
    _, _, _, df = made(spark)
    assert O.value_centres(df.limit(0), 4) == []
    assert O.value_centres(df.where("value is not null and not isnan(value)").limit(1).withColumn("value", F.lit(2.0)), 4) == [2.0]
    assert len(O.value_centres(df.withColumn("var", F.lit(0.0)), 4, "equal")) == 4
    with pytest.raises(ValueError):
        O.value_centres(df, 4, "other")
