import random

import numpy as np

from brindle.llm import reading

EASY = "cat dog sun run hat cup red box hop big fun bed pig jam toy".split()
HARD = "amortisation jurisdiction heterogeneous stipulation remuneration counterparty authorisation equilibrium indemnification substantiation".split()


def text(rnd, level, n=6):
    share = (level - 1) / 3
    out = []
    for _ in range(n):
        words = [rnd.choice(HARD if rnd.random() < share else EASY) for _ in range(6 + 4 * level)]
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def test_prose():
    rnd = random.Random(1)
    assert reading.is_prose(text(rnd, 2).split())
    for t in ("Annual report 2019", "a | 1 | 2.5\n" * 40, '{"a": 1, "b": 2} ' * 20, "2023-08-08 14:00 WARN step=1 loss=0.5\n" * 9, "→ ☑ № € % 🚀 " * 30, "lr_4: 64\n" * 30):
        assert not reading.is_prose(t.split())
    assert not reading.is_prose(["word"] * 19) and reading.is_prose(["word"] * 20)


def test_held_out_accuracy(spark):
    rnd = random.Random(7)
    rows, ratings, truth = [], [], {}
    for i in range(420):
        level = 1 + i % 4
        t = text(rnd, level, rnd.randint(2, 9))
        t = t.lower().replace(".", "") if i % 10 == 0 else t
        rows.append((i, t, "clash"))
        truth[i] = level
        if i < 200:
            ratings += [(i, min(4, max(1, level + (rnd.random() < 0.1)))) for _ in range(2)] + [(i, None)] + [(i, 9)]
    rows += [(1000, None, ""), (1001, "", ""), (1002, "Title only", ""), (1003, "x | 1 | 2\n" * 50, ""), (5, rows[5][1], "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, level string")
    rs = spark.createDataFrame(ratings, "doc_id bigint, level int")
    got = [(r.doc_id, r.level) for r in reading.reading_levels(df, rs).collect()]
    assert len(got) == 421 and {d for d, _ in got} == set(range(420))
    held = [(d, v) for d, v in got if d >= 200]
    assert np.mean([v == truth[d] for d, v in held]) > 0.85
    assert all(abs(v - truth[d]) <= 1 for d, v in held)
    assert reading.reading_levels(df, rs.limit(0)).count() == 0 and reading.reading_levels(df.limit(0), rs).count() == 0
