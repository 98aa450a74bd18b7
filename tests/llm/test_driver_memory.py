"""What the driver holds while a source mixture or a classifier is fitted."""

import tracemalloc

import numpy as np

from chunklake.llm.classifier import fit
from chunklake.llm.mixing import _newton_step


def test_newton_steps_grow_the_plan_by_one_table_each(spark):
    done = (None, 3.0, 12.0, float("inf"), -60.0, 60.0, True)
    state = spark.createDataFrame([("a", 2.0, 9.0, 0.0, -60.0, 60.0, False), done], "source string, mean double, target double, tilt double, low double, high double, done boolean")
    bars = spark.createDataFrame([("a", 1, 2), ("a", 3, 2), (None, 3, 2)], "source string, size long, n long")
    after = state
    for _ in range(4):
        after = _newton_step(after, bars, 2.0)
    assert after._jdf.queryExecution().analyzed().collectLeaves().size() == 5
    rows = {r.source: r for r in after.collect()}
    assert tuple(rows[None]) == done and rows["a"].done
    assert abs(sum(2 * s * min(2.0, np.exp(rows["a"].tilt * s / 2.0)) for s in (1, 3)) - 9) < 2e-3


def test_fit_needs_few_copies_of_its_features():
    rng, n = np.random.default_rng(1), 1 << 20
    rows, cols, vals = np.sort(rng.integers(0, 500, n)), rng.integers(0, 1 << 18, n), rng.random(n)
    y = np.arange(500) % 3
    tracemalloc.start()
    model = fit((rows, cols, vals), y, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 36 << 20
    assert np.array_equal(np.flatnonzero(model.weights), np.unique(cols))
