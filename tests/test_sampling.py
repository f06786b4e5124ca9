"""Optimal samples against the layers of all paths."""

import random

import pytest

from motifmill.operators import sampling


def least_cost(weights: dict[int, int], size: int, links: int) -> int:
    """The cheapest path of `links` links over all places, layer by layer."""
    link = lambda i, j: sum(weights.get(t, 0) * (t - i) for t in range(i, j))
    best = {0: 0}
    for _ in range(links):
        nxt = {}
        for i, c in best.items():
            for j in range(i + 1, size + 1):
                nxt[j] = min(nxt.get(j, c + link(i, j)), c + link(i, j))
        best = nxt
    return best[size]


@pytest.mark.parametrize(("seed", "size", "rate", "block", "most"), [(1, 40, 4, 5, 30), (2, 50, 10, 7, 2), (3, 30, 3, 4, 1000), (4, 36, 40, 6, 9)])
def test_optimal_samples_cost_as_little_as_any(spark, seed, size, rate, block, most):
    rng = random.Random(seed)
    weights = {p: rng.choice([0, 1, rng.randint(1, most)]) for p in range(size)}
    rows = [(p, w if w else rng.choice([None, 0, -3])) for p, w in weights.items()]
    got = sorted(r["pos"] for r in sampling.optimal_samples(spark.createDataFrame(rows, "pos long, weight long"), rate, block).collect())
    links = min(-(-size // rate), 1 + sum(w > 0 for p, w in weights.items() if p))
    assert got[0] == 0 and len(set(got)) == len(got) == links
    cost = sum(w * (p - max(s for s in got if s <= p)) for p, w in weights.items())
    assert cost == least_cost(weights, size, links)


def test_samples_of_few_and_no_places(spark):
    chosen = lambda rows: sorted(r["pos"] for r in sampling.optimal_samples(spark.createDataFrame(rows, "pos long, weight long"), 2).collect())
    assert chosen([]) == []
    assert chosen([(None, 3)]) == []
    assert chosen([(0, 0), (1, 0), (2, 0)]) == [0]
    assert chosen([(1, 4), (9, 2)]) == [0, 1, 9]
    assert chosen([(0, 5), (1, 1), (2, 9), (3, 1)]) == [0, 2]


def test_paths_are_put_together_in_few_steps(spark, monkeypatch):
    rng = random.Random(5)
    weights = {p: rng.randint(1, 50) for p in range(90)}
    names = []
    monkeypatch.setattr(sampling, "stored", lambda df, what, keep=sampling.stored: names.append(what) or keep(df, what))
    got = sorted(r["pos"] for r in sampling.optimal_samples(spark.createDataFrame(list(weights.items()), "pos long, weight long"), 3, 20).collect())
    assert len(got) == 30
    assert sum(w * (p - max(s for s in got if s <= p)) for p, w in weights.items()) == least_cost(weights, 90, 30)
    assert names.count("path") == 2 and "steps" not in names  # one for each of two paths, however many links they have
