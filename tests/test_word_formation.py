import random

from contrasta.operators import word_formation as W


def distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(rows[-1][j] + (x != y), rows[-1][j + 1] + 1, row[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, rows[-2][j - 1] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def test_near_words_equal_all_pairs(spark):
    r = random.Random(2)
    words = [sorted({"".join(r.choices("abc", k=r.randint(1, 6))) for _ in range(130)}) for _ in range(2)]
    frames = [spark.createDataFrame([(w,) for w in [*ws, ws[0], None, ""]], "word string") for ws in words]
    got = {(x.x, x.y): x.edits for x in W.near_words(*frames).collect()}
    assert got == {(a, b): distance(a, b) for a in words[0] for b in words[1] if distance(a, b) <= 1}


def leaks(spark, answers, classes, rules=W.EXTENDED):
    out = W.class_leaks(spark.createDataFrame(list(enumerate(answers)), "answer int, name string"), spark.createDataFrame(list(enumerate(classes)), "class int, name string"), rules)
    return {(answers[r.answer], classes[r["class"]]): r.evidence for r in out.collect()}


def test_rules(spark):
    answers = ["Aristotle", "Confucius", "Mao", "German", "Platonism", "Fluorine", "Marx", None, "Artistic"]
    classes = ["Aristotelian philosophers", "Confucianism", "Maoists", "Maori people", "Germanic tribes", "Platonist", "Fluorinated compounds", "Marxism", "", "Artist"]
    got = leaks(spark, answers, classes)
    assert got["Aristotle", "Aristotelian philosophers"] == ["aristotle~aristotelian:CLASS_DERIVATIONAL_IAN_D1"]
    assert got["Mao", "Maoists"] == ["mao~maoists:CLASS_EPONYMIC_EXACT_ISTS_D0"] and ("Mao", "Maori people") not in got
    assert got["Marx", "Marxism"] == ["marx~marxism:CLASS_EPONYMIC_EXACT_ISM_D0"]
    assert any("CLASS_DERIVATIONAL_IC_D0" in x for x in got["German", "Germanic tribes"])
    assert any("DERIVATIONAL_ATED" in x for x in got["Fluorine", "Fluorinated compounds"])
    assert got["Artistic", "Artist"] == ["artistic~artist:ANSWER_DERIVATIONAL_IC_D0"]
    assert not any(a is None or c == "" for a, c in got)
    plain = leaks(spark, answers, classes, W.Rules())
    assert ("Mao", "Maoists") not in plain and ("Fluorine", "Fluorinated compounds") not in plain
    assert set(plain) <= set(got)


def test_two_suffixes(spark):
    words = spark.createDataFrame([("aristotelianism",), ("germanic",), ("buddhism",)], "word string")
    got = {(r.word, r.stem, r.path) for r in W.derived_stems(words, W.Rules()).collect()}
    assert {x for x in got if x[0] == "aristotelianism"} == {("aristotelianism", "aristotelian", "ism"), ("aristotelianism", "aristotel", "ism_ian"), ("aristotelianism", "aristoteli", "ism_an")}
    assert {x[1] for x in got if x[0] == "germanic"} == {"german"} and not any(x[0] == "buddhism" for x in got)


def test_verdicts_only_rise(spark):
    pairs = spark.createDataFrame([(1, 1, "NONE", []), (1, 2, "SOFT", ["s"]), (1, 3, "HARD", ["h"]), (1, 4, "SOFT", ["s"])], "answer int, class int, verdict string, evidence array<string>")
    found = spark.createDataFrame([(1, c, ["f"]) for c in (1, 2, 3)], "answer int, class int, evidence array<string>")
    got = {r["class"]: (r.final, r.source, r.evidence) for r in W.extended_verdict(pairs, found).collect()}
    assert got == {1: ("HARD", "WORD_FORMATION", ["f"]), 2: ("HARD", "WORD_FORMATION", ["s", "f"]), 3: ("HARD", "NAME", ["h", "f"]), 4: ("SOFT", "NAME", ["s"])}
