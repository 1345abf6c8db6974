import math
import random

import numpy as np
import pytest

from gneiss.operators import resampling, search

SPACE = search.Space(
    {"kind": search.Choice(("a", "b")), "x": search.Real(1e-3, 1e1, log=True), "n": search.Whole(1, 9)}, conditions={"n": ("kind", "b")}
)


def objective(p):
    return -abs(math.log10(p["x"]) + 1) - (0 if p["kind"] == "b" else 0.5) - abs(p.get("n", 5) - 5) / 10


@pytest.mark.parametrize("method", sorted(search.METHODS))
def test_methods_keep_the_budget_and_remember(method):
    e = search.search(method, SPACE, objective, 16)
    assert 0 < len(e.history) <= 16 and len({SPACE.key(h["params"]) for h in e.history}) == len(e.history)
    assert [h["best"] for h in e.history] == list(np.maximum.accumulate([h["score"] for h in e.history]))
    assert e.history == search.search(method, SPACE, objective, 16).history


def test_inactive_parameters_do_not_count():
    assert SPACE.key({"kind": "a", "x": 1.0, "n": 3}) == SPACE.key({"kind": "a", "x": 1.0, "n": 7})
    assert len(SPACE.grid(20)) <= 20


def test_a_failure_scores_worst():
    def bad(p):
        if p["kind"] == "a":
            raise RuntimeError("no")
        return 1.0

    e = search.search("random", SPACE, bad, 10, seed=3)
    assert e.best()["score"] == 1.0 and any(h["error"] for h in e.history)


def test_halving_costs_four_full_fits():
    best, log = search.successive_halving(SPACE, lambda p, share: objective(p) * share)
    assert math.isclose(sum(h["share"] for h in log), 4.0) and set(best) >= {"kind", "x"}


def test_intervals_and_sets():
    rng = np.random.default_rng(0)
    x = rng.normal(1, 1, 200)
    point, low, high = resampling.bootstrap_bca(lambda a: float(a.mean()), x, n=500)
    assert low < point < high and high - low < 0.5
    losses = np.column_stack([rng.normal(1, 0.3, 300), rng.normal(1, 0.3, 300), rng.normal(2, 0.3, 300)])
    p = resampling.confidence_set(np.column_stack((losses, losses[:, 0])), ["a", "b", "c", "a again"], n=300)
    assert p["a"] == p["a again"] and p["a"][1] and not p["c"][1]
    assert resampling.confidence_set(losses, ["a", "b", "c"], alpha=0.0, n=300)["a"] == (1.0, True)
    assert resampling.reality_check(losses[:, 2], losses[:, :2], n=300)["better"] >= 1 > resampling.reality_check(losses[:, 0], losses[:, 2:], n=300)["better"]
    assert resampling.reality_check(losses[:, 2], losses[:, :2], n=300)["spa"] < 0.05
    assert resampling.reality_check(losses[:, 0], losses[:, 2:], n=300)["reality_check"] > 0.5
    found = resampling.reality_check(losses[:, 2], np.column_stack((losses, losses[:, 2] + rng.normal(0.5, 0.3, 300))), n=300, names=["a", "b", "same", "worse"])
    assert found["names"] == ["a", "b"] and found["better"] == 2 and found["spa_lower"] <= found["spa"] <= found["spa_upper"] < 0.05
    assert resampling.reality_check(losses[:, 0], losses[:, :1])["spa"] == 1.0
    i = resampling.stationary_indices(50, 5, np.random.default_rng(random.Random(1).randint(0, 9)))
    assert len(i) == 50 and 0 <= i.min() and i.max() < 50
