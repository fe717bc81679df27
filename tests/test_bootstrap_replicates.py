"""The interval for large tables draws as many replicates as the small one, with whole multiplicities."""

import inspect
import math

from lodestone.operators import evaluation as E


def test_replicates_and_multiplicities():
    samples = lambda f: inspect.signature(f).parameters["samples"].default
    assert samples(E.poisson_bootstrap) == samples(E.bootstrap) == 1000
    assert E.POISSON[-1] >= 1 - 2**-52 and math.isclose(E.POISSON[7] - E.POISSON[6], math.exp(-1) / math.factorial(7), rel_tol=1e-6)


def test_interval_of_a_large_table(spark):
    df = spark.range(20_000).selectExpr("'g' AS g", "id AS k", "CAST(id % 2 AS DOUBLE) AS v")
    r = E.poisson_bootstrap(df, "g", "k", "v").first()
    half = 1.96 * 0.5 / math.sqrt(20_000)
    assert abs(r["lower"] - 0.5 + half) < 0.0012 and abs(r["upper"] - 0.5 - half) < 0.0012
