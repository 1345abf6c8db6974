import math

import numpy as np
import pytest

from gneiss.operators import residuals


def plain(y, fitted, lags, block):
    """The statistics by their definitions, over all pairs in blocks."""
    e, n = y - fitted, len(y)
    x = e - e.mean()
    design = np.column_stack([np.ones(n), fitted, fitted**2])
    square = e * e
    left = square - design @ np.linalg.lstsq(design, square, rcond=None)[0]
    out = {"white": n * (1 - left @ left / ((square - square.mean()) ** 2).sum())}
    for m in lags:
        out[f"q_{m}"] = n * (n + 2) * sum((x[k:] @ x[:-k] / (x @ x)) ** 2 / (n - k) for k in range(1, m + 1))
    ps = []
    for start in range(0, n - block + 1, block):
        b = e[start : start + block]
        near = [[abs(p - q) < 1.5 * b.std(ddof=1) for q in b] for p in b]
        pairs = lambda at, both: sum(near[i][j] and (not both or near[i - 1][j - 1]) for i in at for j in at if i < j) / (len(at) * (len(at) - 1) / 2)  # noqa: B023, E731
        whole, later = range(block), range(1, block)
        c, c1, c2 = pairs(whole, False), pairs(later, False), pairs(later, True)
        triples = sum(sum(near[i][j] for j in whole if j != i) ** 2 - sum(near[i][j] for j in whole if j != i) for i in whole)
        k = triples / (block * (block - 1) * (block - 2))
        z = math.sqrt(block - 1) * (c2 - c1 * c1) / (2 * (k - c * c))
        ps.append(math.erfc(abs(z) / math.sqrt(2)))
    return out, ps


def test_bundle_equals_definitions(spark):
    rng = np.random.default_rng(2)
    fitted = rng.normal(size=260)
    y = fitted + rng.normal(size=260) * (1 + np.abs(fitted))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, fitted, strict=True))] + [(900, None, 1.0), (901, 1.0, None), (None, 1.0, 1.0)]
    rng.shuffle(rows)
    got = residuals.residual_bundle(spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) for r in rows], "row long, y double, fitted double"), (3, 6), 60).first()
    want, ps = plain(y, fitted, (3, 6), 60)
    assert got.n == 260
    assert all(got[name] == pytest.approx(value) for name, value in want.items())
    assert got.p_white == pytest.approx(math.exp(-want["white"] / 2))
    assert got.p_6 == pytest.approx(math.exp(-want["q_6"] / 2) * sum((want["q_6"] / 2) ** i / math.factorial(i) for i in range(3)))
    fisher = -2 * sum(map(math.log, ps))
    assert got.p_blocks_fisher == pytest.approx(math.exp(-fisher / 2) * sum((fisher / 2) ** i / math.factorial(i) for i in range(len(ps))))
    assert got.p_blocks_holm == pytest.approx(min(1, len(ps) * min(ps)))
    assert got.p_jarque_bera == pytest.approx(math.exp(-got.jarque_bera / 2))


def test_bundle_without_rows_or_spread(spark):
    none = residuals.residual_bundle(spark.createDataFrame([], "row long, y double, fitted double")).first()
    assert none.n == 0 and none.p_white is None and none.p_10 is None and none.p_blocks_fisher is None
    flat = residuals.residual_bundle(spark.createDataFrame([(i, 1.0, 1.0) for i in range(30)], "row long, y double, fitted double")).first()
    assert flat.n == 30 and flat.q_10 is None and flat.p_white is None and flat.p_jarque_bera is None
