import random

import pytest
from pyspark.sql import functions as F

from gneiss.llm import mixing

WEIGHTS = (3, 1, 2)


def reshared(sizes, share=1.5, epochs=2):
    """Targets by resharing what is above a limit, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        total, over = sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * weight[s] / total
            if target[s] >= epochs * sizes[s]:
                over += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
                free.discard(s)
        left = over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for source, n in [("b", 40), ("a", 300), (None, 60), ("é", 25), ("Z", 3), ("empty", 2), ("c", 200)]:
        for _ in range(n):
            words = 0 if source == "empty" else rng.choice([0, 1, 5, 30, 30, 80])
            out.append((len(out), " ".join(rng.choice("abcd") for _ in range(words)) or None, source))
    return out


def test_plan_reaches_targets(frame, rows):
    got = mixing.plan(mixing.measure(frame(rows, "doc_id long, text string, source string"))).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target = reshared(sizes)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r["size"] == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in own)
        assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(size.values()) / 2
        if sizes[s]:
            assert {r.copies for r in own} <= {int(target[s] // sizes[s]), int(target[s] // sizes[s]) + 1}
            # whoever is drawn has a smaller key than whoever isn't
            drawn = [r.draw for r in own if r["size"] and r.copies > target[s] // sizes[s]]
            rest = [r.draw for r in own if r["size"] and r.copies == target[s] // sizes[s]]
            assert not drawn or not rest or min(drawn) > max(rest)


def test_reruns_and_partitions_agree(frame, rows):
    docs = frame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, mixing.plan(mixing.measure(d)).select("doc_id", "target", "taken").collect())) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    assert runs[0] == runs[1] == runs[2]
    assert runs[0] != sorted(map(str, mixing.plan(mixing.measure(docs, seed=18)).select("doc_id", "target", "taken").collect()))


def test_quality_weights_the_draw(frame):
    rows = [(i, "a b c", s) for i in range(2000) for s in ("x", "y", "z")]
    docs = mixing.measure(frame(rows, "doc_id long, text string, source string"))
    got = mixing.plan(docs, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5).where("copies > 0").groupBy("source").agg(F.avg((F.col("doc_id") % 2 == 0).cast("int")).alias("even"), F.count("*").alias("n")).collect()
    for r in got:
        # keys of quality q reach t with 1 - exp(-q t): t such that the share r.n / 2000 is drawn
        lo, hi = 0.0, 50.0
        for _ in range(60):
            t = (lo + hi) / 2
            drawn = 1 - (2.718281828 ** (-4 * t) + 2.718281828 ** (-t)) / 2
            lo, hi = (t, hi) if drawn < r.n / 2000 else (lo, t)
        expected = (1 - 2.718281828 ** (-4 * lo)) / (2 - 2.718281828 ** (-4 * lo) - 2.718281828 ** (-lo))
        assert r.even == pytest.approx(expected, abs=0.06)
    last = mixing.plan(docs, F.when(F.col("doc_id") < 1000, 0.0).otherwise(1.0), share=0.25).where("copies > 0 and source <> 'x'")
    assert last.count() > 0 and last.where("doc_id < 1000").count() == 0


def test_repeated_rows_are_partly_drawn(frame):
    rows = [(1, "a b c d", "x")] * 1000 + [(2, "a", "y"), (3, "b b", "z")]
    got = mixing.plan(mixing.measure(frame(rows, "doc_id long, text string, source string")), share=0.9).collect()
    own = [r for r in got if r.doc_id == 1]
    assert len(got) == 1002 and abs(sum(r.taken for r in own) - own[0].target) <= 2 and {r.copies for r in own} == {0, 1}


def test_mix_repeats_documents(frame, rows):
    docs = frame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.plan(mixing.measure(docs)).where("size > 0").collect()}
    mixed = mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("last")).collect()
    assert {r.doc_id: r.n for r in mixed} == {i: n for i, n in copies.items() if n} and all(r.last == r.n - 1 for r in mixed)


def test_share_above_the_limit_and_empty_tables(frame):
    schema = "doc_id long, text string, source string"
    assert mixing.plan(mixing.measure(frame([], schema))).count() == 0
    got = mixing.plan(mixing.measure(frame([(1, "a b", "x"), (2, "c", None), (None, None, None)], schema)), share=3).collect()
    assert sorted((r["size"], r.taken) for r in got) == [(0, 0), (1, 2), (2, 4)]
    none = mixing.plan(mixing.measure(frame([(1, "", "x"), (2, None, None)], schema))).collect()
    assert [(r.taken, r.target) for r in none] == [(0, 0.0)] * 2
