import numpy as np
import pytest

from vintagekit.operators.quantiles import exact_quantile


@pytest.mark.parametrize("bins,small,q", [(4096, 10_000, 0.1), (64, 3, 0.5), (16, 1, 0.9), (16, 1, 0.0)])
def test_quantile_agrees_with_numpy(spark, bins, small, q):
    rng = np.random.default_rng(6)
    for values in ([4.0], list(rng.normal(0, 1, 301)), [7.0] * 40 + [9.0] * 40,
                   list(10.0 ** rng.uniform(-5, 5, 200)), [-1e308, 1e308, 0.0]):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "v double")
        assert exact_quantile(df, "v", q, bins, small) == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_nothing_has_no_quantile(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5) is None
