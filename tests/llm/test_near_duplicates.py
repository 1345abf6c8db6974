import re
from collections import Counter

import numpy as np

from gneiss.llm import cap_filters, jaccard_join
from gneiss.llm import text as T

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(n, link):
    part = list(range(n))
    for i in range(n):
        for j in range(i):
            if part[i] != part[j] and link(i, j):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    return part


def test_components_equal_brute_force(frame, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    sets = [shingle_set(t) for _, t in rows]
    part = components(len(rows), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    least = {p: min(rows[i][0] for i in range(len(rows)) if part[i] == p) for p in set(part)}
    want = Counter((rows[i][0], len(sets[i]), least[part[i]] if sets[i] else rows[i][0]) for i in range(len(rows)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(rows)).collect())
    assert got == want


def test_null_ids_and_empty_table(frame, corpus):
    assert jaccard_join.near_duplicates(frame(corpus)).count() == len(corpus)
    assert jaccard_join.near_duplicates(frame([])).count() == 0


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(1)
    for size in [2, 3, 5, 8, 13, 40, 200, 900]:
        for _ in range(40):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            grow = rng.integers(0, max(1, size // 4) + 1)
            drop = rng.integers(0, size // 9 + 1)
            b = np.concatenate((a[drop:], rng.integers(0, 2**63, grow).astype(np.uint64)))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inter < 80 * union:
                continue
            a, b = np.unique(a), np.unique(b)
            keys = [set(jaccard_join._keys(x, np.array([0, len(x)]))[0].tolist()) for x in (a, b)]
            assert keys[0] & keys[1] or len(a) == len(b) == inter


def test_shingles_of_rows_in_one_buffer():
    texts = ["a b c d e f", "", "x y", "a b c d e", "A B  C\td E"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    hashes, at = T.shingles(np.frombuffer(data, np.uint8), offsets)
    sets = [set(hashes[x:y].tolist()) for x, y in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 0, 1, 1, 1]
    assert sets[3] == sets[4] and sets[3] < sets[0]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((250, 16))
    x[50:90] = x[0] + 0.1 * rng.standard_normal((40, 16))
    x[90:110] = x[1]
    x[110:120] = 3 * x[2]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(250)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0, 2.0], 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    part = components(250, lambda i, j: link[i, j])
    got = {r.vec_id: r for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class_id int")).collect()}
    assert len(got) == len(rows)
    found, true = sum(got[i].n_links for i in range(250)), int(link.sum()) - 250
    assert 0.97 * true <= found <= true
    assert all(got[i].n_links <= link[i].sum() - 1 for i in range(250))
    assert sum(got[i].component_id == part[i] for i in range(250)) >= 247
    for i in range(900, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_near_the_least_cosine_are_found(spark):
    for cosine in (0.901, 0.95):
        x, y = cap_filters.random_pairs(1000, 64, cosine, seed=11)
        rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate((x, y)))]
        got = {r.vec_id: r.component_id for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert np.mean([got[i] == got[1000 + i] for i in range(1000)]) >= 0.97


def test_every_vector_gets_its_best_directions():
    x = np.random.default_rng(2).standard_normal((200, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, codes = cap_filters._codes(30, 20)
    rows, found = cap_filters._decode(x @ turn, codes, 0.9)
    s = [(x @ turn)[:, part] @ words.T for part, words in codes]
    for i in range(200):
        sums = (s[0][i][:, None, None] + s[1][i][:, None] + s[2][i]).ravel()
        assert set(found[rows == i].tolist()) == set(np.argsort(-sums)[: cap_filters.LEAST].tolist())


def test_scaled_copies_link(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 16))
    scales = [1.0, 1e-170, 1e170, 1e-300, 1e300]
    rows = [(100 * i + j, [float(v) for v in x[i] * s]) for i in range(60) for j, s in enumerate(scales)]
    rows += [(9000, [5e-324] + [0.0] * 15), (9001, [1.0] + [0.0] * 15)]
    got = {r.vec_id: r for r in cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links == len(scales) - 1 and got[i].component_id == i // 100 * 100 for i, _ in rows[:-2])
    assert got[9000].n_links == 1 and got[9001].component_id == 9000
