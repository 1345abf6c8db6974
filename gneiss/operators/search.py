"""Hyper-parameter search: typed spaces and five ways through them.

This is the control plane: a handful of parameter sets on the driver. Every
evaluation is a Spark job given as a function of the parameters.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

Params = dict[str, float | int | str]
Objective = Callable[[Params], float]


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def at(self, u: float) -> float:
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return self.low + u * (self.high - self.low)

    def grid(self, n: int) -> list[float]:
        return [self.at((i + 0.5) / n if n == 1 else i / (n - 1)) for i in range(n)]


@dataclass(frozen=True)
class Whole(Real):
    def at(self, u: float) -> int:
        return min(int(self.high), max(int(self.low), round(super().at(u))))

    def grid(self, n: int) -> list[int]:
        return list(dict.fromkeys(super().grid(n)))


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]

    def at(self, u: float) -> str:
        return self.values[min(int(u * len(self.values)), len(self.values) - 1)]

    def grid(self, n: int) -> list[str]:
        return list(self.values[:n]) if n < len(self.values) else list(self.values)


@dataclass(frozen=True)
class Space:
    """Named domains; a condition (parameter, value) makes a parameter count only there."""

    domains: dict[str, Real | Whole | Choice]
    conditions: dict[str, tuple[str, str]] = field(default_factory=dict)

    def canonical(self, p: Params) -> Params:
        return {k: v for k, v in p.items() if k not in self.conditions or p.get(self.conditions[k][0]) == self.conditions[k][1]}

    def key(self, p: Params) -> str:
        return "|".join(f"{k}={v!r}" for k, v in sorted(self.canonical(p).items()))

    def decode(self, u: list[float]) -> Params:
        return {k: d.at(min(max(x, 0.0), 1.0)) for (k, d), x in zip(self.domains.items(), u, strict=True)}

    def centre(self) -> Params:
        return self.decode([0.5] * len(self.domains))

    def grid(self, budget: int) -> list[Params]:
        """The finest even grid of at most ``budget`` distinct points, levels added in turn."""
        levels = dict.fromkeys(self.domains, 1)

        def points(n: dict[str, int]) -> list[Params]:
            out: list[Params] = [{}]
            for k, d in self.domains.items():
                out = [p | {k: v} for p in out for v in d.grid(n[k])]
            return list({self.key(p): p for p in out}.values())

        grew = True
        while grew:
            grew = False
            for k in self.domains:
                more = levels | {k: levels[k] + 1}
                if len(self.domains[k].grid(more[k])) > len(self.domains[k].grid(levels[k])) and len(points(more)) <= budget:
                    levels, grew = more, True
        return points(levels)


class Evaluator:
    """Scores parameters within a budget; equal parameters cost once, a failure scores -inf."""

    def __init__(self, space: Space, objective: Objective, budget: int):
        self.space, self.objective, self.budget = space, objective, budget
        self.known: dict[str, float] = {}
        self.history: list[dict] = []

    @property
    def left(self) -> int:
        return self.budget - len(self.history)

    def __call__(self, p: Params) -> float:
        key = self.space.key(p)
        if key not in self.known:
            if self.left <= 0:
                return -math.inf
            try:
                score, error = float(self.objective(self.space.canonical(p))), None
            except Exception as e:  # one failed fit must not end a search
                score, error = -math.inf, repr(e)[:200]
            self.known[key] = score
            best = max([score, *(h["score"] for h in self.history)])
            self.history.append({"t": len(self.history) + 1, "score": score, "best": best, "params": self.space.canonical(p), "error": error})
        return self.known[key]

    def best(self) -> dict:
        return max(self.history, key=lambda h: h["score"])


def grid_search(e: Evaluator, seed: int) -> None:
    for p in e.space.grid(e.budget):
        e(p)


def random_search(e: Evaluator, seed: int) -> None:
    rng = random.Random(seed)
    for _ in range(50 * e.budget):
        if e.left <= 0:
            return
        e(e.space.decode([rng.random() for _ in e.space.domains]))


def density_search(e: Evaluator, seed: int, candidates: int = 24) -> None:
    """Tree-structured Parzen estimation: draw near good points, prefer where good is dense and bad is not."""
    rng, n = random.Random(seed), len(e.space.domains)
    tried: list[tuple[list[float], float]] = []

    def density(u: list[float], points: list[list[float]]) -> float:
        width = max(0.05, len(points) ** (-1 / (n + 4)) / 2)
        kernels = [math.exp(-sum((a - b) ** 2 for a, b in zip(u, p, strict=True)) / (2 * width * width)) / width**n for p in points]
        return (sum(kernels) + 1.0) / (len(points) + 1)

    tries = 0
    while e.left > 0 and tries < 50 * e.budget:
        tries += 1
        if len(tried) < max(3, e.budget // 4):
            u = [rng.random() for _ in range(n)]
        else:
            ranked = [p for p, _ in sorted(tried, key=lambda t: -t[1])]
            cut = max(1, math.ceil(0.25 * math.sqrt(len(ranked)) + 0.1 * len(ranked)))
            good, bad = ranked[:cut], ranked[cut:]
            drawn = [[min(max(rng.gauss(x, 0.15), 0.0), 1.0) for x in rng.choice(good)] for _ in range(candidates)]
            u = max(drawn, key=lambda v: density(v, good) / density(v, bad))
        tried.append((u, e(e.space.decode(u))))


def genetic_search(e: Evaluator, seed: int) -> None:
    """Tournaments of three, blend crossover, Gaussian mutation, the best survives."""
    rng, n = random.Random(seed), len(e.space.domains)
    size = max(4, e.budget // 4)
    people = [[rng.random() for _ in range(n)] for _ in range(size)]
    for _ in range(50 * e.budget):
        scored = [(e(e.space.decode(u)), u) for u in people]
        if e.left <= 0:
            return
        pick = lambda: max(rng.sample(scored, min(3, len(scored))), key=lambda s: s[0])[1]
        young = [max(scored, key=lambda s: s[0])[1]]
        while len(young) < size:
            a, b = pick(), pick()
            child = [x + (y - x) * rng.uniform(-0.5, 1.5) for x, y in zip(a, b, strict=True)] if rng.random() < 0.7 else list(a)
            young.append([min(max(x + rng.gauss(0, 0.15), 0.0), 1.0) if rng.random() < 0.4 else min(max(x, 0.0), 1.0) for x in child])
        people = young


METHODS = {"grid": grid_search, "random": random_search, "density": density_search, "genetic": genetic_search}


def search(method: str, space: Space, objective: Objective, budget: int, seed: int = 42) -> Evaluator:
    e = Evaluator(space, objective, budget)
    METHODS[method](e, seed)
    return e


def successive_halving(space: Space, objective: Callable[[Params, float], float], n: int = 27, eta: int = 3, seed: int = 42) -> tuple[Params, list[dict]]:
    """All candidates on a small share of the rows, the best 1/eta on eta times as many, up to all rows."""
    rng, log = random.Random(seed), []
    alive = [space.decode([rng.random() for _ in space.domains]) for _ in range(n)]
    share = 1.0 / n
    while True:
        scored = sorted(((objective(space.canonical(p), min(share, 1.0)), i, p) for i, p in enumerate(alive)), key=lambda s: (-s[0], s[1]))
        log += [{"share": min(share, 1.0), "score": s, "params": p} for s, _, p in scored]
        alive = [p for _, _, p in scored[: max(1, len(scored) // eta)]]
        if share >= 1.0 or len(scored) == 1:
            return scored[0][2], log
        share *= eta
