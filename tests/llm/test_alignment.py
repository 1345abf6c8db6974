import hashlib
from collections import Counter, defaultdict

import sentencepiece
from tokenizers import Tokenizer

from gneiss.llm import alignment
from gneiss.llm.tokenizer_files import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["it's <|endoftext|> 42!! <s> a</s><unk>", "a  b   c ", "  ", " ", " x", "　a b  c  d", "👍🏽 한국 नि", "a▁b c", "▁ b ▁", "a\x00b \x01", "a \n b\n\n  c\t d", "<0x41> <0x0A>", "x" * 3000, "İı ß ﬁ é Å é", "a\x1c b\x85 c", "'s 's", "\n", "a\r\n b"]


def brute(rows):
    """Figures of each row by the two libraries on whole texts."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out, held = [], Counter()
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_lib.encode(text) if text else []
        spell_a = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            out.append(None)
            continue
        spans = []
        for spelled in (spell_a, spell_b):
            at, own = 0, []
            for s in spelled:
                own.append((at, at + len(s)))
                at += len(s)
            spans.append(own)
        links = [(i, j) for i, x in zip(ids_a, spans[0]) for j, y in zip(ids_b, spans[1]) if max(x[0], y[0]) < min(x[1], y[1])] if len(raw) < 4000 else None
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            own = [[], []]
            while i < len(ids_a) and spans[0][i][1] <= cut:
                own[0].append(str(ids_a[i]))
                i += 1
            while j < len(ids_b) and spans[1][j][1] <= cut:
                own[1].append(str(ids_b[j]))
                j += 1
            groups.append("|".join(map(",".join, own)))
        out.append((len(ids_a), len(ids_b), len(cuts), links, ";".join(groups)))
        held.update(set(links or []))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], x[2], len(x[3]), sum(held[p] == most[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]) for x in out], held


def test_vocabularies_are_separable():
    assert alignment.separable(A, B)


def test_alignment_equals_brute_force(frame, corpus):
    rows = [(i, t) for i, t in corpus if len(t or "") < 4000] + [(700 + i, t) for i, t in enumerate(ODD)]
    expected, held = brute(rows)
    got = alignment.align_documents(frame(rows), A, B).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(((i, *e) for (i, _), e in zip(rows, expected, strict=True)), key=key)
    assert sum(e[0] == 0 for e in expected) >= 5
    short = alignment.align_documents(frame(rows), A, B, digests=True)
    digests = Counter((r.doc_id, r.groups_sha256) for r in short.collect())
    assert digests == Counter((i, hashlib.sha256(e[-1].encode()).hexdigest() if e[-1] else "") for (i, _), e in zip(rows, expected, strict=True))
    assert {(r.a, r.b): r.n_docs for r in alignment.pair_counts(frame(rows), A, B).collect()} == dict(held)


def test_many_chunks_shards_and_blocks_change_nothing(frame, corpus, monkeypatch):
    rows = [(i, t) for i, t in corpus if i is not None] + [(700 + i, t) for i, t in enumerate(ODD)]
    whole = sorted(map(tuple, alignment.align_documents(frame(rows), A, B).collect()))
    for name, value in {"CHUNK_BYTES": 3000, "BLOCK": 64}.items():
        monkeypatch.setattr(alignment, name, value)
    frame([]).sparkSession.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(tuple, alignment.align_documents(frame(rows), A, B).collect())) == whole
    finally:
        frame([]).sparkSession.conf.set("spark.sql.shuffle.partitions", "4")


def test_without_a_cut_segments_are_whole_texts(frame, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)]
    cut = sorted(map(tuple, alignment.align_documents(frame(rows), A, B).collect()))
    monkeypatch.setattr(alignment, "separable", lambda a, b: False)
    assert sorted(map(tuple, alignment.align_documents(frame(rows), A, B).collect())) == cut


def test_empty_table_and_repeated_rows(frame):
    assert alignment.align_documents(frame([]), A, B).count() == 0
    got = alignment.align_documents(frame([(1, "a b"), (1, "a b"), (None, None)]), A, B, digests=True).orderBy("n_a").collect()
    assert [r.doc_id for r in got] == [None, 1, 1] and got[1] == got[2] and got[0].groups_sha256 == ""
