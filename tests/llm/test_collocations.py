import random
import re
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from gneiss.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, min_count, top=2000, inside=100):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(own)
            for m in range(1, 6):
                counts.update((lang, *own[i : i + m]) for i in range(len(own) - m + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= min_count}
    gone = set()
    for p, a in candidates.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                part = (p[0], *p[i : i + m])
                if 100 * a >= inside * candidates[part]:
                    gone.add(part)
    out = {}
    for p, a in candidates.items():
        if p not in gone:
            lang, own = p[0], p[1:]
            score, _, l, r = min((1000 * a * total[lang] // (counts[lang, *own[:k]] * counts[lang, *own[k:]]), k, counts[lang, *own[:k]], counts[lang, *own[k:]]) for k in range(1, len(own)))
            out.setdefault(lang, []).append((-score, -a, " ".join(own).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["The", "of", "to", "New", "York", "City", "über", "größe", "a", "b", "x9", "İ", "|"]
    out = []
    for i in range(160):
        own = []
        for _ in range(rng.randint(0, 40)):
            own += rng.choice([["new", "York", "City", "of", "the"], ["of", "the"], ["über", "größe"], [rng.choice(vocabulary)], [rng.choice(vocabulary)], [f"rare{rng.randint(0, 500)}"]])
            own[-1] += rng.choice(["", "", "", ".", ",", "\n", "\x0b", "\t"])
        out.append((i, " ".join(own), rng.choice(["en", "en", "de", None, "und"])))
    return out + [(900, None, "en"), (901, "", None), (902, "...", "fr"), (903, "of the " * 3000, "en"), (1, out[1][1], out[1][2]), (None, out[2][1], "de")]


def _got(frame, rows, **options):
    return sorted(tuple(r) for r in collocations.collocations(frame(rows, SCHEMA), **options).collect())


@pytest.mark.parametrize(("min_count", "top", "inside"), [(10, 2000, 100), (10, 7, 100), (3, 2000, 80), (10**6, 5, 100)])
def test_report_equals_brute_force(frame, rows, min_count, top, inside):
    expected = sorted(brute(rows, min_count, top, inside))
    assert _got(frame, rows, min_count=min_count, top=top, inside=inside) == expected
    assert (min_count == 10**6) == (not expected)


def test_hot_words_shards_and_chunks_change_nothing(frame, rows, monkeypatch):
    for name, value in {"TASK_ROWS": 60, "CHUNK_BYTES": 4000, "HASHED_BYTES": 500, "FAN": 5}.items():
        monkeypatch.setattr(collocations, name, value)
    assert _got(frame, rows, min_count=10) == sorted(brute(rows, 10))


def test_clashing_hashes_are_hashed_anew(frame, rows, monkeypatch):
    seen, real = [], collocations._word_hashes

    def clashing(data, start, end, lang, attempt):
        hashes = real(data, start, end, lang, attempt)
        return hashes % np.uint64(7) + np.uint64(1) if attempt < 2 else hashes

    def counted(attempt, run=collocations._counted):
        seen.append(attempt)
        return run(attempt)

    monkeypatch.setattr(collocations, "_word_hashes", clashing)
    monkeypatch.setattr(collocations, "_counted", counted)
    assert _got(frame, rows, min_count=10) == sorted(brute(rows, 10))
    assert seen == [0, 1, 2]


def test_phrase_counts_and_empty_tables(frame, rows):
    assert collocations.collocations(frame([], SCHEMA)).count() == 0
    assert collocations.collocations(frame([(1, None, None)], SCHEMA)).count() == 0
    counts, known, langs = collocations.phrase_counts(frame(rows, SCHEMA), 10)
    expected = Counter()
    for lang, _, phrase, a, *_ in brute(rows, 10, inside=10**9):
        expected[len(phrase.split(" "))] += 1
    got = {int(r.m): r["count"] for r in counts.groupBy((F.octet_length("phrase") / 8).alias("m")).count().collect()}
    assert got[1] == known.count() and {m: n for m, n in got.items() if m > 1} == dict(expected)
    assert {r.lang for r in langs.collect()} == {"en", "de", "und", "fr"}
