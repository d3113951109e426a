import random

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import overlap


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_agreeing_is_the_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert overlap.agreeing(a, b) == t[-1][-1]


def test_words_ignore_form():
    want = ["the", "eclair", "cafe", "x1"]
    for t in ("The éclair, café x1", "THE  <b>ÉCLAIR</b>\n café&nbsp;X1", "the ECLAIR cafe x1."):
        assert overlap.words(t) == want
    assert overlap.words(None) == [] and overlap.words(" \n<p></p>") == []


def test_pairs_against_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    hot = " ".join(vocabulary[:60])
    rows = []

    def add(train, text):
        rows.append((len(rows), train, [text], "clash", 1))

    for i in range(120):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 7, 12, 25, 27, 40, 90]))]
        add(True, " ".join(base))
        for share in rnd.sample([0.0, 0.03, 0.08, 0.3], 2):
            near = [w if rnd.random() > share else "new" for w in base]
            add(False, "Re: " * (len(base) > 10) + " ".join(near).upper())
    for i in range(150):  # a third of all rows begins alike
        add(i % 2 == 0, hot + " " + " ".join(rnd.choice(vocabulary) for _ in range(40)))
    for i in range(70):
        add(i % 2 == 0, "Copy  of the same text, many times over")
    for t in (None, "", " ", "..."):
        add(True, t)
        add(False, t)
    add(None, "Copy of the same text many times over")
    schema = "key bigint, train boolean, texts array<string>, x string, n int"
    df = spark.createDataFrame(rows, schema)
    want = set()
    for a in rows:
        for b in rows:
            if a[1] and b[1] is False and overlap.words(a[2][0]) and overlap.words(b[2][0]) and overlap.almost_same([overlap.words(t) for t in a[2]], [overlap.words(t) for t in b[2]]):
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {tuple(r) for r in overlap.cross_split(df).collect()}
    assert len(want) > 1200 and got == want
    assert overlap.cross_split(df.limit(0)).count() == 0


def found(spark, rows):
    df = spark.createDataFrame([(i, train, [text]) for i, (train, text) in enumerate(rows)], "key bigint, train boolean, texts array<string>")
    return {tuple(r) for r in overlap.cross_split(df).collect()}


def test_every_pair_of_a_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        near = list(base)
        for at in rnd.sample(range(120), 2):
            near[at] = f"new{i}x{at}"
        rows.append((i >= 60, " ".join(near)))
    assert found(spark, rows) == {(a, b) for a in range(60) for b in range(60, 260)}


def test_repeated_phrases(spark):
    phrase = ("please call us " * 7).split()[:20]
    rows = [(True, " ".join(phrase)), (False, " ".join(phrase[:-1] + ["now"])), (True, "no " * 40), (False, "no " * 40 + "yes"), (False, "yes " * 40)]
    assert found(spark, rows) == {(0, 1), (2, 3)}


def test_words_left_out_at_some_places_and_put_in_at_others(spark):
    base = [f"w{i}" for i in range(24)]
    near = [w for i, w in enumerate(base) if i not in (4, 10, 16, 22)]
    for at in (19, 13, 7, 1):
        near.insert(at, f"new{at}")
    assert found(spark, [(True, " ".join(base)), (False, " ".join(near))]) == {(0, 1)}


def test_every_sixth_word_changed(spark):
    for n in (6, 18, 26, 36, 60, 120, 600):
        base = [f"w{i}" for i in range(n)]
        near = [f"new{i}" if i % 6 == 5 else w for i, w in enumerate(base)]
        far = ["other" if i % 6 == 5 or i == 0 else w for i, w in enumerate(base)]
        assert found(spark, [(True, " ".join(base)), (False, " ".join(near)), (False, " ".join(far))]) == {(0, 1)}, n


def test_fields_with_the_same_first_text(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for i in range(120):  # one question with many answers, some of them near copies
        answer = [f"a{rnd.randrange(90)}" for _ in range(30)]
        rows.append((2 * i, True, ["What is it then", " ".join(answer)]))
        near = answer[:-1] + ["end"] if i % 3 == 0 else [f"b{rnd.randrange(90)}" for _ in range(30)]
        rows.append((2 * i + 1, False, ["what is it then?", " ".join(near)]))
        if i % 3 == 0:
            want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, "key bigint, train boolean, texts array<string>")
    assert {tuple(r) for r in overlap.cross_split(df).collect()} == want
