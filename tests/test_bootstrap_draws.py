import random

import pytest

from lodestone.operators import evaluation


def one_by_one(values, statistic, samples, seed):
    draw, n = random.Random(seed).randrange, len(values)
    found = [statistic([values[draw(n)] for _ in range(n)]) for _ in range(samples)]
    return round(evaluation.percentile(found, 0.025), 4), round(evaluation.percentile(found, 0.975), 4)


@pytest.mark.parametrize("n", [2, 3, 4, 7, 64, 1000, 1025])
def test_draws_are_those_of_the_standard_generator(n):
    rng = random.Random(n)
    for values in ([rng.random() for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]):
        mean = lambda v: sum(v) / len(v)
        assert evaluation.bootstrap(values, mean, 40, seed=n) == one_by_one(values, mean, 40, n)


def test_no_draw_is_made_alone(monkeypatch):
    monkeypatch.setattr(random.Random, "randrange", None)
    assert evaluation.bootstrap([1.0, 1.0, 1.0], lambda v: sum(v) / len(v), 5) == (1.0, 1.0)
