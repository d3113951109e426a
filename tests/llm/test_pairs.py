import random
import re
import time

from pyspark.sql import functions as F

from brindle.llm import pairs

SCHEMA = "tbl string, key bigint, question string, answer string, tokens int, source string, defect string"
EN = "The old clerk moved the green box after the long meeting because the window near the door was broken and the rain came in."
DE = "Der alte Beamte hat die grüne Kiste nach der Sitzung bewegt, denn das Fenster neben der Tür ist nicht mehr ganz und der Regen kam."
FR = "Le vieux commis déplace la boîte verte dans la salle pour les clients avec une lettre, mais nous avons une autre table sur la route."


def test_one_pair_at_a_time():
    assert all(pairs.is_empty(x) for x in (None, "", " ​\n", "<p></p>", "N/A", "[no answer]", "Answer:", "...", "{}", '""'))
    assert not any(pairs.is_empty(x) for x in ("Yes", "5 %", "No.", "42", "None of the boats sailed."))
    q = "Why is the green boat linked to the old river at Dorath?"
    assert all(pairs.is_copy(q, x) for x in (q, "Q: " + q.upper(), f'"{q}"', q + " " + q, "Why is the green boat linked to old river at Dorath"))
    assert not pairs.is_copy(q, q + " The boat was built by the owner of the river bank in 1990, and both were sold.")
    assert not pairs.is_copy(q, "Yes") and not pairs.is_copy(None, "x y") and not pairs.is_copy(q, None)


def test_defects(spark):
    rows, want = [], {}

    def add(answer, defect=None, question="How does the broken window near the door change the meeting?", tbl="t"):
        key = len(rows)
        rows.append((tbl, key, question, answer, None, "s", "clash"))
        if defect:
            want[tbl, key] = defect

    for i in range(60):  # words used less than RARE times prove no cut
        add(f"{EN} It was number {i}.")
        add(f"{DE} Es war Nummer {i}.", question="Wie hat das Fenster neben der Tür die Sitzung bewegt?")
        add(f"{FR} Le numéro est {i}.", question="Comment la boîte verte est dans la salle avec les clients?")
    subjects = "harbour bakery violin glacier lantern orchard compass tunnel blanket falcon ladder kettle saddle anchor bottle candle hammer pillow".split()
    for i, subject in enumerate(subjects):
        opening = ("Unfortunately, ", "Well, ", "Hello, ")[i % 3]
        reason = (".", ", because the matter is confidential.", ". Please call the office on Monday morning.")[i // 3 % 3]
        add(f"{opening}I am not able to answer request {i} of that list{reason}", "refusal", f"Who built the {subject}?")
        add(f"The {subject} was built by the owner of the mill.", None, f"Who built the {subject}?")
    add("I am not able to answer request 7 of that list. " + EN)
    for i in range(6):  # one passage under variants of one question is an answer, however often it stands
        add(f"{EN} It rained.", None, ("what", "why", "when", "how", "who", "where")[i] + " about the zanzibar mosaic")
    add(f"{DE} {DE}", "other_language", "How does the broken window near the door change the meeting?")
    add(f"{DE} {DE}", None, "How does the broken window near the door change the meeting? (reply in German)")
    add(f'{EN} It said: "{DE}"')
    add(None, "empty")
    add("n/a", "empty", None)
    add("How does the broken window near the door change the meeting?", "copy")
    add(EN[:57], "truncated")
    add("Yes")
    df = spark.createDataFrame(rows + [rows[-5]], SCHEMA)
    got = {(r.tbl, r.key): r.defect for r in pairs.defects(df).collect()}
    assert got == want
    assert pairs.defects(df.limit(0)).count() == 0


def test_clusters_are_closed_over_all_links_of_a_bucket(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[3 * i : 3 * i + 40]) for i in range(4)]  # each like the next one, the first unlike the last
    rows = [(u, i) for u in chain for i in range(2)] + [("alone " + " ".join(f"v{i}" for i in range(20)), i) for i in range(2)] + [("once " + chain[0], 1)]
    df = spark.createDataFrame(rows, "opening string, answer bigint")
    got = pairs.opening_clusters(df).collect()
    assert {r.opening for r in got} == set(chain) and len({r.cluster for r in got}) == 1


def test_pieces_recur_only_under_unrelated_prompts(spark):
    rows = [("template", i, [100 + i, 1], i) for i in range(9)]  # prompts share a word that all have
    rows += [("passage", 10 + i, [50 + i // 2, 1], i) for i in range(4)]  # two of each subject
    rows += [("copied", 20 + i, [200 + i, 1], 7) for i in range(4)]  # one answer alone
    df = spark.createDataFrame(rows, "u string, prompt bigint, asked array<bigint>, answer bigint")
    assert [r.u for r in pairs.recurring(df, "u").collect()] == ["template"]


def test_every_pair_of_openings_at_the_threshold_is_linked(spark):
    words = lambda i, n: " ".join(f"w{i}n{j}" for j in range(n))
    alike = [(words(i, 8), words(i, 9)) for i in range(3000)]  # 4 of 5 shingles: four minima miss one of 600
    unlike = [(words(i, 7), words(i, 9)) for i in range(3000, 3050)]  # 3 of 5
    rows = [(u, k) for pair in alike + unlike for u in pair for k in range(2)]
    got = pairs.opening_clusters(spark.createDataFrame(rows, "opening string, answer bigint")).collect()
    assert {r.opening for r in got} == {u for pair in alike for u in pair}
    assert len({r.cluster for r in got}) == 3000


def test_an_opening_of_one_answer_links_others(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[3 * i : 3 * i + 40]) for i in range(3)]  # the middle one opens a single answer
    df = spark.createDataFrame([(chain[0], 0), (chain[0], 1), (chain[1], 2), (chain[2], 3), (chain[2], 4)], "opening string, answer bigint")
    got = pairs.opening_clusters(df, answers=1).collect()
    assert {r.opening for r in got} == set(chain) and len({r.cluster for r in got}) == 1


def test_many_openings_of_one_template_do_not_meet_pair_by_pair(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    rows = [(f"we have tested the model on lines of {name(i)}", i) for i in range(30_000)]  # 4 of 5 shingles are of all, no two alike
    rows += [(f"but {u}", i) for u, i in rows[:100]]  # 5 of 6 shingles
    df = spark.createDataFrame(rows, "opening string, answer bigint")
    began = time.monotonic()
    got = pairs.opening_clusters(df, answers=1).collect()
    assert time.monotonic() - began < 60  # 450 million pairs of one shingle take far longer
    assert {r.opening for r in got} == {u for u, _ in rows[:100] + rows[30_000:]} and len({r.cluster for r in got}) == 100


def test_similar_pairs_are_those_of_all_pairs(spark):
    dice = random.Random(5)
    sets = []
    for i in range(60):
        base = [1000 * i + j for j in range(dice.choice((1, 2, 4, 5, 9, 31, 40, 50, 80)))]
        for _ in range(6):
            kept = [x for x in base if dice.random() > 0.08] + [dice.randrange(20) for _ in range(dice.randrange(3))]
            sets.append(sorted({*kept, 10**6} if dice.random() < 0.5 else {*kept, 0}))
    sets.append(sets[0])
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    found = pairs.alike_sets(spark.createDataFrame(list(enumerate(sets)), "u bigint, s array<bigint>"))
    of = {}
    for r in found.collect():
        of.setdefault(r.c, set()).add(r.u)
    got = {(min(a, b), max(a, b)) for r in pairs.similar_pairs(found.filter("u = c")).collect() for a in of[r.a] for b in of[r.b]}
    same = {(a, b) for c in of.values() for a in c for b in c if a < b}
    assert got <= want and want - got == same & want and len(got) > 100


def test_units_are_those_of_the_pattern_and_cheaper():
    stops = re.compile(r"[.,;:!?()\[\]\"“”«»\n–—]+|\s-\s|\b(?=(?:because|weil|denn|parce|car|porque)\b)")
    letters = re.compile(r"[^\W\d_]+")

    def slow(answer):
        parts = (" ".join(letters.findall(p)) for p in stops.split(answer.lower().replace("'", " ").replace("’", " ")))
        return [p for p in parts if p]

    dice = random.Random(7)
    bits = "because denn car cars xcar CAR é İ ß ª ½ ٣ 5 _ - – . , ' ’ “ * ́ 中文 a b".split() + [" - ", " ", " ", " ", "\n", "\t", "\r", "\xa0", "\0"]
    for _ in range(20_000):
        text = "".join(dice.choices(bits, k=dice.randint(1, 14)))
        assert pairs.units(text) == slow(text), repr(text)

    def seconds(f):
        began = time.process_time()
        for _ in range(1500):
            f(f"{EN} {DE} {FR}")
        return time.process_time() - began

    assert min(seconds(pairs.units) for _ in range(5)) < 0.9 * min(seconds(slow) for _ in range(5))


def test_a_crowd_of_openings_all_alike_is_not_compared_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CROWD", 20)
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    stem = "we regret that after a careful look at all of the papers nothing can be said here about the house of "
    alike = {f"{but}{stem}{name(i)}" for i in range(200) for but in ("", "but ")}  # each its own class, as its variant shares its last words
    far = [f"{' '.join(f'x{i}n{j}' for j in range(3))} {' '.join(stem.split()[:14])} end{k}" for i in range(40) for k in range(2)]  # like its variant alone
    df = spark.createDataFrame([(u, i) for i, u in enumerate([*sorted(alike), *far])], "opening string, answer bigint")
    clusters = {}
    for r in pairs.opening_clusters(df, answers=1).collect():
        clusters.setdefault(r.cluster, set()).add(r.opening)
    assert sorted(map(sorted, clusters.values())) == sorted([sorted(alike), *(sorted(far[2 * i : 2 * i + 2]) for i in range(40))])
    sets = pairs.alike_sets(df.select(F.xxhash64("opening").alias("u"), pairs.shingles(F.col("opening")).alias("s"))).filter("u = c")
    assert pairs.similar_pairs(sets).count() < 5000  # of 79,800 true pairs
