"""The test of Shapiro and Wilk on more values than are fetched."""

import random

import numpy as np
import pytest

from lattica.functions import special as P
from lattica.operators import stats as T


def weights_in_one_place(x):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([P.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = n**-0.5, m @ m
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / mm**0.5], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / mm**0.5], u)
    a = m / ((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)) ** 0.5
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def frame(spark, values):
    return spark.createDataFrame([("b", v) for v in values] + [("a", 7.0), ("b", None)], "column string, value double")


def test_more_than_five_thousand_values(spark):
    r = random.Random(3)
    for values in ([r.gauss(100, 3) for _ in range(6000)], [float(r.randrange(9)) for _ in range(7000)]):
        got = T.shapiro_wilk(frame(spark, values).repartition(5), "b")
        assert got["n"] == len(values) and got["w"] == pytest.approx(weights_in_one_place(values), abs=1e-10)
        assert got["p"] == P.shapiro_p(got["w"], len(values))
    assert T.shapiro_wilk(frame(spark, [2.0] * 5001), "b") == {"w": 1.0, "p": 1.0, "n": 5001}


def test_few_values_are_as_before(spark):
    x = [float(v) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)]
    got = T.shapiro_wilk(frame(spark, x), "b")
    assert (got["w"], got["p"]) == P.shapiro(x) and got["w"] == pytest.approx(weights_in_one_place(x), abs=1e-12)
