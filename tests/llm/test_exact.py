import hashlib
import itertools
import random
import re

import numpy as np

from gneiss.llm import fingerprints, pii, suffix_dedup


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_substrings_equal_brute_force(frame, corpus):
    rows = list({i: (i, t) for i, t in corpus if i is not None}.values())
    want = brute_removal(rows)
    # whole groups in memory, then blocks so small that groups are in several, then splitters so dense that equal suffixes are in several buckets
    for options in ({}, {"block_strings": 60}, {"bucket": 60, "block_strings": 500}):
        got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(frame(rows), keep_text=True, **options).collect()}
        assert {i: (*tuple(r)[:5], bytes(r.kept)) for i, r in got.items()} == want, options


def test_frequent_suffixes_are_dealt_over_their_splitters():
    head, mark = np.repeat(np.array([3, 7, 9], np.uint64), 200), np.full(600, 5, np.uint64)
    splitters = np.sort(suffix_dedup._ordered(np.array([7, 7, 7, 7, 8], np.uint64), np.array([5, 5, 5, 5, 0], np.uint64)))
    bucket, hot = suffix_dedup._buckets(splitters, head, mark, np.arange(600))
    assert set(bucket[:200]) == {0} and set(bucket[200:400]) == {1, 2, 3, 4} and set(bucket[400:]) == {5}
    assert hot.tolist() == [False] * 200 + [True] * 200 + [False] * 200


def test_texts_that_share_a_class_number_are_told_apart():
    a, b = (suffix_dedup.class_of(t) for t in (b"x", b"y"))
    assert suffix_dedup.class_of(b"x", frozenset([a])) != a and suffix_dedup.class_of(b"y", frozenset([a])) == b


def test_substrings_of_repeated_and_null_rows(frame, corpus):
    got = suffix_dedup.dedup_substrings(frame(corpus)).collect()
    assert len(got) == len(corpus)
    assert suffix_dedup.dedup_substrings(frame([])).count() == 0


def test_fingerprints_equal_definition(frame, corpus):
    rows = list({i: (i, t) for i, t in corpus if i is not None}.values())
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(rows)).collect()}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        f = [fingerprints.digest(fingerprints.canonical(x)) for x in (t, edited, n)]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (f[0], f[1], float(f[0] == f[1]), float(f[0] == f[2]))


def test_colliding_digests_are_told_apart(frame, monkeypatch):
    from pyspark.sql import functions as F

    docs = frame([(1, "a"), (2, "b"), (3, "A"), (4, "c")], extra=False)
    rows = docs.select("doc_id", F.lit(fingerprints.digest("a")).alias("fingerprint"))
    real = fingerprints._forms

    def same(wanted):
        def run(batches):
            for b in real(wanted)(batches):
                yield b

        return run

    monkeypatch.setattr(fingerprints, "_forms", same)
    assert fingerprints._collisions(docs, rows).count() == 0  # only "a" has that digest
    assert fingerprints.fingerprints(frame([])).count() == 0
    assert fingerprints.fingerprints(frame([(None, None), (None, "x"), (1, "x"), (1, "x")])).count() == 4


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_patterns():
    rng = random.Random(2)
    parts = ["a", "b@c.de", "@", "x.y@z.w.v", "1", "23", "4.", "1.2.3.4", "256.1.1.1", "+", "+1 (", "319) ", "555-", "5132", " ", "-", "4425414259157784", "4539 1488 0343 6467", "é", ".", "%", "7"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("x" * 50_000 + "@" + "1" * 50_000) == []


def test_field_adds_repeated_numbers_and_keeps_base(frame):
    rows = [(i, f"call +1 (319) 555-{5000 + i} now") for i in range(30)] + [(i + 50, f"card 4425414259157784 and ip 10.0.0.{i}") for i in range(30)]
    rows += [(99, "call +1 (319) 555-0148 or 1 (319) 555-0148"), (100, None), (101, ""), (102, "plain words")]
    got = {r.doc_id: r for r in pii.find(frame(rows)).collect()}
    for i, t in rows:
        base = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(got[i].spans.split(","))
    masked = {r.doc_id: r.text for r in pii.mask(frame(rows)).collect()}
    assert masked[50] == "card <card> and ip <ip>" and masked[100] is None and masked[102] == "plain words"
    assert pii.find(frame([])).count() == 0


def enumerated(field, shapes, labels, chain, skip):
    node = pii._bits(shapes) @ field.weights
    total = np.zeros((len(shapes), 5))
    for y in itertools.product(range(5), repeat=len(shapes)):
        if any(k and k != v for k, v in zip(labels, y, strict=True)):
            continue
        z = sum(node[i, v] for i, v in enumerate(y)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip)
        for i, v in enumerate(y):
            total[i, v] += np.exp(z)
    return total / total.sum(1, keepdims=True)


def test_beliefs_equal_enumeration():
    rng = np.random.default_rng(6)
    for loop in (False, True):
        for _ in range(5):
            table = rng.normal(0, 1, (5, 5))
            field = pii.Field(rng.normal(0, 0.5, (pii._BITS + 1, 5)), rng.normal(0, 0.5, (5, 5)), table + table.T)
            shapes, labels = rng.integers(0, 2**pii._BITS, 5), np.array([0, 3, 0, 0, 0])
            chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3], [2, 4]] + [[3, 4]] * loop)
            got, want = pii.beliefs(field, shapes, labels, chain, skip), enumerated(field, shapes, labels, chain, skip)
            assert np.abs(got - want).max() < (0.1 if loop else 1e-3)


def test_added_spans_have_precision_and_recall(frame):
    rng = random.Random(8)
    rows, wanted = [], {}
    for i in range(400):
        area, line = rng.randint(200, 989), rng.randint(1000, 9999)
        full, bare = f"+1 ({area}) 555-{line}", rng.choice([f"1 ({area}) 555-{line}", f"{area} 555 {line}", f"1-{area}-555-{line}"])
        order = f"{rng.randint(10**7, 10**8 - 1)}"
        text = f"call {full} or write; ticket {order} of 2023 " + "and then some words " * rng.randint(1, 20)
        if i % 2:
            start = len(text) + 6
            text += f"again {bare} soon, ticket {order}"
            wanted[i] = f"phone:{start}:{start + len(bare)}"
        rows.append((i, text))
    got = {r.doc_id: r for r in pii.find(frame(rows)).collect()}
    added = {i: set(got[i].spans.split(",")) - set(pii.written(pii.base_spans(t)).split(",")) for i, t in rows}
    hits = sum(wanted.get(i) in a for i, a in added.items())
    assert hits >= 0.9 * len(wanted) and hits >= 0.95 * sum(map(len, added.values()))


def test_messages_carry_labels_over_skip_edges():
    field = pii.Field(np.zeros((pii._BITS + 1, 5)), np.zeros((5, 5)), np.eye(5) * 3)
    none, unknown = np.zeros((0, 2), int), np.zeros(400, int)
    known = unknown.copy()
    known[0] = 4
    shapes = np.zeros(400, int)
    star = np.array([[0, i] for i in range(1, 400)])
    alone, joined = pii.beliefs(field, shapes, unknown, none, none), pii.beliefs(field, shapes, known, none, star)
    assert (joined[1:, 4] > 0.8).all() and np.allclose(alone, 0.2)
    path = np.array([[i, i + 1] for i in range(60)])
    assert pii.beliefs(pii.Field(field.weights, np.eye(5) * 9, field.skip), shapes, known, path, none)[60, 4] > 0.9  # until settled
