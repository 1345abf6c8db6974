import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gneiss.llm import line_dedup, ngram_quality, toxicity


def test_toxicity_learns_words_and_ignores_held_out_labels(spark, frame):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        words = [f"v{j}" for j in rng.integers(0, 300, 30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.integers(0, 30)] = rng.choice(["scum!", "Idiots", "idiot"])
        if i % 3 == 0:
            words.append("muslim" if toxic else "jewish")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "muslim people"), (903, "jewish people"), (904, "IDIOT")]
    docs = frame(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if i % 7 == 0]
    assert np.mean(held) > 0.95 and got[904] > 0.5
    assert abs(got[902] - got[903]) < 0.05 and got[902] < 0.5  # the swap penalty
    assert got[900] == got[901] < 0.5
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(0 <= r.toxicity_score < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(frame([]), model).count() == 0


def test_a_group_of_toxic_rows_weighs_as_any_other(spark, frame):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(2000):
        words = [f"v{j}" for j in rng.integers(0, 300, 20)]
        toxic = i % 5 == 0
        if toxic and rng.random() < 0.7:
            words[0] = "idiot"
        if rng.random() < (0.6 if toxic else 0.05):
            words[1] = rng.choice(["muslim", "Muslims", "muslim's"])
        elif rng.random() < 0.1:
            words[1] = "christian"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    probes = ["the muslim people", "the christian people", "the jewish people", "those muslims", "those christians", "those women"]
    docs = frame(rows + [(9000 + i, t) for i, t in enumerate(probes)])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    assert np.ptp([got[9000 + i] for i in range(3)]) < 0.05 and np.ptp([got[9003 + i] for i in range(2)]) < 0.05
    assert max(got[9000 + i] for i in range(len(probes))) < 0.5
    assert toxicity.swapped("no group") is None and toxicity.swapped("Womens' rights") not in (None, "Womens' rights")


def test_lines_equal_sql(spark, frame):
    letters = "abcdefghijkl"
    body = [f"quite {c * 3} a long and {c * 4} sentence of {c * 5} its own that {c * 6} nobody else has" for c in letters]
    rows = [(i, f"Page {i} of 90\n{body[i]}\nCopyright {2000 + i} Some Company Inc\n{letters[i]} text\n\nend{i}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "one"), (53, "Copyright 1999 Some Company Inc"), (60, "Copyright 2024 Some Company Inc\nmine alone"), (54, "\n\n"), (1, rows[1][1]), (None, rows[2][1])]
    article = [f"line {'abcdefghij'[i] * 3} of an article that is copied with a change" for i in range(10)]
    rows += [(70 + i, "\n".join([*article[:i], f"changed {'abcdefghij'[i] * 2}", *article[i + 1 :]])) for i in range(10)]
    got = line_dedup.drop_recurring_lines(frame(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].text == f"{body[3]}\nd text\n\nend3" and by[3].n_dropped == 2
    assert by[53].text == "" and by[50].text is None and by[51].text == "" and by[60].text == "mine alone"
    assert all(by[i].n_dropped == 0 for i in range(70, 80))  # near copies are one document
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    sql = con.execute(line_dedup.oracle(digests=False)).fetchall()
    assert Counter(map(str, ((r.doc_id, r.text) for r in got))) == Counter(map(str, sql))
    assert line_dedup.drop_recurring_lines(frame([])).count() == 0


def brute_kneser_ney(words, order):
    counts = Counter()
    for w, n in words.items():
        for g in ngram_quality.grams(w):
            counts[g] += n
    asked, levels = set(counts), [Counter({g: n for g, n in counts.items() if n})]
    for k in range(order - 1, 0, -1):
        up = Counter()
        for g in levels[-1]:
            up[g[-k:]] += 1
        levels.append(up)
    alphabet = len(levels[-1])

    def discounts(c):
        n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(v, 0.1), m - 0.05) for v, m in zip(raw, (1, 2, 3), strict=True)]

    cuts = [discounts(c) for c in levels]

    def p(g, depth):
        low = p(g[1:], depth + 1) if depth < order - 1 else 1 / (alphabet + 1)
        own = {h: n for h, n in levels[depth].items() if h[:-1] == g[:-1]}
        if not own:
            return low
        cut = lambda n: cuts[depth][min(n, 3) - 1] if n else 0.0
        total = sum(own.values())
        return (own.get(g, 0) - cut(own.get(g, 0))) / total + sum(map(cut, own.values())) / total * low

    return {g: math.log(p(g, 0)) for g in asked}


def test_perplexity_equals_brute_force(spark, frame):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "That hat", "zzz qqq xxx", None, "", "\u00e9t\u00e9 \U0001f600 a \x02 \x03", "the cat sat on the mat"]
    roles = [1, 1, 2, 1, 0, 1, 0, None, 1]
    rows = [(i, t, "en", k) for i, (t, k) in enumerate(zip(texts, roles, strict=True))]
    counts = Counter()
    for _, t, _, k in rows:
        for u in ngram_quality.units(t or ""):
            counts[u] += int(k == 1)
    logp = brute_kneser_ney(counts, ngram_quality.ORDER)
    docs = frame(rows, "doc_id long, text string, lang string, role int")
    got = {r.doc_id: r for r in ngram_quality.perplexities(docs, docs.where("role = 1")).collect()}
    for i, t, _, _ in rows:
        own = ngram_quality.units(t or "")
        want = sum(logp[g] for u in own for g in ngram_quality.grams(u))
        assert abs(got[i].log_prob - want) <= got[i].n_chars / 2 / ngram_quality.STEPS + 1e-9
        assert got[i].n_chars == sum(len(w) + 1 for w in (t or "").split())
        assert (got[i].perplexity is None) == (not t)


def test_words_see_the_end_of_the_word_before():
    assert ngram_quality.units("Ab c  d") == ["\r\r\rab", "\rb c", "\rc d"]
    assert ngram_quality.grams("\rb c") == ["\rb c", "b c "]


def test_thresholds_by_language(spark, frame):
    rng = np.random.default_rng(4)
    words = {"en": ["the", "cat", "sat", "on", "mat", "and"], "de": ["der", "hund", "ist", "auf", "dem", "weg"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(7, 1, 0), (900, 0, 0)], "doc_id long, quality int, toxic int")
    rows += [(900, "xq zzk !!wp qqq xzw", "en"), (901, rows[0][1], None), (902, None, "en"), (903, "", None), (rows[3])]
    got = ngram_quality.classify(frame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].kept for i in range(200)]) > 0.9 and by[901].kept
    assert not by[900].kept and not by[902].kept and not by[903].kept
    held = sorted(by[i].perplexity for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert by[0].threshold in held and by[901].threshold == max(by[901].threshold, by[901].perplexity)  # a tie is kept
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept == (r.n_chars > 0) for r in ngram_quality.classify(frame(rows, "doc_id long, text string, lang string"), none).collect())
    assert ngram_quality.classify(frame([], "doc_id long, text string, lang string"), labels).count() == 0


def test_toxicity_weights_equal_a_plain_optimiser(monkeypatch):
    rng = np.random.default_rng(8)
    words = np.arange(1, 7, dtype=np.uint64)
    lists = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(90)]
    other = [sorted(set(v) ^ {0, 1}) for v in lists[:25]]  # copies that swap the first two words
    y = np.array([float(rng.random() < (0.8 if 0 in v or 2 in v else 0.2)) for v in lists])
    kind = pa.list_(pa.int32())
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 7)
    pack = lambda v: toxicity._Rows(pa.array(v, kind))
    got = toxicity._fit(toxicity.Model(-1.0, words), pack(lists), (pack(lists[:25]), pack(other)), y)

    dense = lambda v: np.array([[float(i in own) for i in range(6)] for own in v])
    x, change = np.column_stack([dense(lists), np.ones(90)]), dense(lists[:25]) - dense(other)
    w, ridge = np.zeros(7), np.array([toxicity.RIDGE] * 6 + [1e-6])
    for _ in range(200_000):  # descent on the same loss
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) + ridge * w + 2 * toxicity.COUNTERFACTUAL * np.append(change.T @ (change @ w[:6]), 0)
        w -= slope / (90 + toxicity.RIDGE + 2 * toxicity.COUNTERFACTUAL * 50)
        if np.abs(slope).max() < 1e-8:
            break
    assert np.allclose([*got.weights, got.bias], w, atol=1e-3)
    free = toxicity._fit(toxicity.Model(-1.0, words), pack(lists), (pack([]), pack([])), y)
    gap = lambda v: np.abs(change @ v).mean()
    assert gap(got.weights) < gap(free.weights)


def test_toxicity_query_of_whole_tables(spark):
    """Held-out rows by the checksum of the id, calls by the score, one row a document, and no label of a held-out row used."""
    from gneiss.llm import queries

    path = "/root/testdata/sf0.001"
    got = queries.queries()["op8_toxicity"](spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    whole = spark.read.parquet(f"{path}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    a = toxicity.train(whole, labels)
    b = toxicity.train(whole, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.bias == b.bias and np.array_equal(a.words, b.words) and np.array_equal(a.weights, b.weights)
