import random

import duckdb

from gneiss.llm import line_dedup

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _kept(frame, rows):
    return {r.doc_id: r for r in line_dedup.drop_recurring_lines(frame(rows)).collect()}


def test_boilerplate_goes_whatever_else_is_shared(frame):
    rng = random.Random(8)
    rows, boilerplate, bodies = [], set(), {}
    for group in range(40):
        head, foot = prose(rng, rng.randint(4, 12)) + f" h{group}x", prose(rng, rng.randint(4, 12)) + f" f{group}x"
        boilerplate |= {head, foot}
        for _ in range(10):
            bodies[len(rows)] = prose(rng, rng.randint(8, 30))
            rows.append((len(rows), "\n".join((head, bodies[len(rows)], foot))))
    got = _kept(frame, rows)
    assert sum(line in boilerplate for r in got.values() for line in r.text.split("\n")) == 0
    assert {i: r.text for i, r in got.items()} == bodies


def test_near_copies_stay_whole(frame):
    rng = random.Random(9)
    rows = []
    for group in range(30):
        base = [prose(rng, 15) for _ in range(12)]
        for _ in range(rng.choice([6, 40])):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                words = own[i := rng.randrange(12)].split()
                words[rng.randrange(15)] = f"edit{rng.random()}"
                own[i] = " ".join(words[: rng.choice([14, 15, 15])])
            rows.append((len(rows), "\n".join(own)))
    got = _kept(frame, rows)
    assert sum(r.n_dropped > 0 for r in got.values()) == 0
    assert {i: r.text for i, r in got.items()} == dict(rows)


def test_templates_with_variable_fields_go(frame):
    rng = random.Random(10)
    rows = [(i, f"Page {i} of the annual report\n{prose(rng, 20)}\n\nprinted on day {rng.randint(1, 300)} by user{i} for all") for i in range(8)]
    rows += [(50, rows[0][1]), (51, None), (52, ""), (53, "\n\n"), (54, "alone"), (None, prose(rng, 3)), (55, " ".join(prose(rng, 5000).split()))]
    got = _kept(frame, rows)
    assert all(got[i].n_dropped == 2 and got[i].text == rows[i][1].split("\n")[1] + "\n" for i in range(8)) and got[50].text == got[0].text
    assert [(got[i].text, got[i].n_lines, got[i].n_dropped) for i in (51, 52, 53, 54)] == [(None, 0, 0), ("", 1, 0), ("\n\n", 3, 0), ("alone", 1, 0)]
    assert got[55].text == rows[-1][1]


def test_sql_twin(frame, spark, tmp_path):
    rng = random.Random(12)
    shared = [prose(rng, rng.randint(3, 9)) for _ in range(12)] + ["ref 12 of 40", "ref 7 of 9"]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < rng.choice([0.3, 0.9]) else prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(i + 1000, t) for i, t in rows[:20]] + [(7, None)]
    path = str(tmp_path / "documents.parquet")
    frame(rows, extra=False).coalesce(1).write.parquet(path)
    kept = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text is None) for r in line_dedup.drop_recurring_lines(frame(rows)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.execute(f"select doc_id, n_lines, n_dropped, kept_md5 is null from ({line_dedup.oracle()})").fetchall()
    assert kept == sorted(want) and sum(k[2] for k in kept) > 100
