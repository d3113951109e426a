import random

from brindle.llm import leakage


def make(rnd, vocabulary, n):
    return [rnd.choice(vocabulary) for _ in range(n)]


def test_found_cases(spark):
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ba", "do", "fi", "gu", "ka", "lo") for b in ("rat", "nel", "sim", "pod", "tur", "vix", "zol")]
    items = [(i, " ".join(make(rnd, vocabulary, rnd.randint(80, 160)))) for i in range(40)]
    items[3] = (3, " ".join(w if k % 9 else f"{k}" for k, w in enumerate(items[3][1].split())))
    docs, want = [], set()

    def add(text, *found):
        docs.append((len(docs), text, "clash", 5))
        want.update((len(docs) - 1, f) for f in found)

    filler = lambda n: " ".join(make(rnd, vocabulary, n))
    for i, t in items[:10]:
        w = t.split()
        n = len(w)
        add(filler(50) + ". " + t.upper() + "! " + filler(30), i)
        add("<p>" + "</p>\n<p>".join(" ".join(w[k : k + 12]) for k in range(0, n, 12)) + "</p>", i)
        add(filler(9) + " " + " ".join(x if k % 11 else "changed" for k, x in enumerate(w)), i)
        add(" ".join(w[: int(n * 0.25)]) + " " + filler(60) + " " + " ".join(w[int(n * 0.6) : int(n * 0.85)]), i)
        add(filler(60) + " " + " ".join(w[10:30]))
        add(" ".join(w[: int(n * 0.3)]) + " " + filler(90))
    add(" ".join(str(int(x) + 7) if x.isdigit() else x for x in items[3][1].split()), 3)
    add(items[11][1] + " " + items[12][1], 11, 12)
    for t in (None, "", "one two"):
        add(t)
    schema = "doc_id bigint, text string, item_id string, d int"
    df = spark.createDataFrame(docs + [docs[0]], schema)
    ev = spark.createDataFrame(items + [(90, None), (91, ""), (92, "two words")], "item_id bigint, text string")
    got = {tuple(r) for r in leakage.find_leaks(df, ev).collect()}
    assert got == want
    assert leakage.find_leaks(df.limit(0), ev).count() == 0 and leakage.find_leaks(df, ev.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(1)
    items = [(i, " ".join(make(rnd, [f"v{chr(97 + k)}" for k in range(26)], 60))) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    ev = spark.createDataFrame(items, "item_id bigint, text string")
    half = [(100 + i, " ".join(t.split()[:30])) for i, t in items]
    df = df.unionAll(spark.createDataFrame(half, df.schema))
    whole = {tuple(r) for r in leakage.find_leaks(df, ev).collect()}
    assert whole >= {(i, i) for i in range(30)}
    for size in (600, 100, 1):
        monkeypatch.setattr(leakage, "BLOCK_WINDOWS", size)
        assert {tuple(r) for r in leakage.find_leaks(df, ev).collect()} == whole
