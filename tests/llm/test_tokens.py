import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

from gneiss.llm import packing, word_bpe
from gneiss.llm.tokenizer_files import tokenizer_path

ODD = ["Σίσυφος ΑΣ", "it's <|endoftext|> 42!!", "İı ß ﬁ é Å", "　a\u0085b\x1cc", "👍🏽 한국 नि", "<|ENDOFTEXT|>", "a\x00b"]


def test_packing_is_whole_and_close_to_the_bound(frame, corpus):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = list({i: (i, t) for i, t in corpus if i is not None}.values()) + [(700 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(frame(rows), path).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 1024).all() and own.length.max() <= 1024
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(frame([]), path).count() == 0
    assert packing.pack(frame([(1, "a"), (1, "a"), (None, None)]), path).count() == 3


def test_plan_uses_the_stock_and_reaches_the_bound():
    rng = np.random.default_rng(0)
    for _ in range(20):
        stock = np.zeros(101, np.int64)
        for x in rng.integers(1, 101, 200):
            stock[x] += 1
        patterns = packing.plan(stock, 100)
        used = np.zeros(101, np.int64)
        for pattern, times in patterns:
            assert sum(x * n for x, n in pattern.items()) <= 100
            for x, n in pattern.items():
                used[x] += n * times
        assert (used == stock).all()
        # no two lengths over half a sequence share one; the rest can't beat the sum
        bound = max(-(-int((stock * np.arange(101)).sum()) // 100), int(stock[51:].sum()))
        assert sum(t for _, t in patterns) <= 1.04 * bound + 1


def test_plan_branches_where_first_choices_waste():
    stock = np.zeros(1025, np.int64)
    for x in (612, 561, 510, 357, 357, 255, 204, 153):
        stock[x] += 1000
    patterns = packing.plan(stock)
    used = np.zeros(1025, np.int64)
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= 1024
        for x, n in pattern.items():
            used[x] += n * times
    assert (used == stock).all() and sum(t for _, t in patterns) <= 3000


def test_proven_plans_equal_brute_force():
    def fewest(lengths, spaces):
        if not lengths:
            return len(spaces)
        fits = {s for s in spaces if s >= lengths[0]}
        options = [sorted([*spaces[: spaces.index(s)], *spaces[spaces.index(s) + 1 :], s - lengths[0]]) for s in fits]
        return min(fewest(lengths[1:], o) for o in [*options, sorted([*spaces, 20 - lengths[0]])])

    rng, proven = np.random.default_rng(4), 0
    for _ in range(30):
        lengths = sorted((int(x) for x in rng.integers(3, 15, 7)), reverse=True)
        stock = np.bincount(lengths, minlength=21)
        best, whole = packing.branch_and_bound(stock, 20, packing._best_fit(stock, 20))
        proven += whole
        assert not whole or sum(t for _, t in best) == fewest(lengths, [])
    assert proven >= 25


def test_word_bpe_equals_the_library(frame, corpus):
    path = tokenizer_path("word_bpe_49k.json")
    rows = list({i: (i, t) for i, t in corpus if i is not None}.values()) + [(700 + i, t) for i, t in enumerate(ODD)]
    tokenizer = Tokenizer.from_file(path)
    full = {r.doc_id: r for r in word_bpe.encode_decode(frame(rows), path).collect()}
    short = {r.doc_id: r for r in word_bpe.encode_decode(frame(rows), path, digests=True).collect()}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        raw, text = np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)
        assert (full[i].n_tokens, bytes(full[i].ids), full[i].decoded) == (len(ids), raw, text)
        assert (short[i].ids_sha256, short[i].decoded_sha256) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert word_bpe.encode_decode(frame([]), path).count() == 0
    assert word_bpe.encode_decode(frame([(None, None), (1, "a"), (1, "a")]), path).count() == 3


def test_every_letter_is_split_as_the_library_does():
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), word_bpe._own_split(path)
    for c in range(0x530):
        text = f"a{chr(c)}B 1{chr(c)} {chr(c)}'s"
        assert word_bpe.split(text, path) == own(text), hex(c)
    single, _ = word_bpe._tokenizer(path)
    for a in range(0x530, 0x110000, 512):
        text = " ".join(f"a{chr(c)}b{chr(c)}" for c in range(a, min(a + 512, 0x110000)) if not 0xD800 <= c < 0xE000)
        words = word_bpe.split(text, path)
        ids = [i for e in single.encode_batch(words, add_special_tokens=False) for i in e.ids]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, hex(a)
