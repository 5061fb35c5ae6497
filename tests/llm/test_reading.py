import dataclasses
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.reading import Batch, ReadingSettings, cut_points, document_word_graph, marked_words, propagate, reading_levels, sentence_edges

DOC = "doc_id long, text string, lang string, score double, grade double"
GRADE = "doc_id long, rater string, reading_level int"
EASY = ["The box was split.", "We sent it back.", "I saw it on the dock.", "The man cut the lid."]
HARD = ["Notwithstanding the antecedent jurisprudence, the indemnification presupposes reciprocal assent.", "The reconciliation exemplifies a heuristically defensible asymmetry of information."]
MID = ["The invoice lists more cases than the receiving stamp confirms.", "Please review the attached remittance before the balance is released."]
CLAUSE = "All goods remain the property of the seller until the funds have cleared."


def text(rng, kind, n):
    return " ".join(rng.choice(kind) for _ in range(n))


def corpus(spark):
    rng = random.Random(3)
    kinds = {1: (EASY, 24), 3: (MID, 12), 5: (HARD, 12)}
    rows, grades, truth = [], [], {}
    for i in range(240):
        level = (1, 3, 5)[i % 3]
        rows.append((i, text(rng, *kinds[level]) + "\n\n" + CLAUSE, "en", None, None))
        truth[i] = level
        if i < 90:
            grades += [(i, "a", level)] + ([(i, "b", min(5, level + (i % 30 == 0)))] if i % 2 else [])
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(grades, GRADE), truth


def test_held_out_levels(spark):
    docs, grades, truth = corpus(spark)
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, grades).collect()}
    assert set(got) == set(range(90, 240))
    assert sum(got[i] == truth[i] for i in got) / len(got) > 0.95


def test_who_gets_a_level(spark):
    docs, grades, _ = corpus(spark)
    odd = spark.createDataFrame([(500, None, "en", 0.0, 0.0), (501, "", "en", None, None), (502, "short text only.", "en", None, None), (503, " ".join(EASY * 9), None, None, None), (504, " ".join(HARD * 4000), "en", None, None), (504, " ".join(HARD * 9), "en", None, None), (505, "1 2 3 " * 40, "en", None, None)], DOC)
    got = sorted((r.doc_id, r.reading_level) for r in reading_levels(docs.union(odd), grades).collect() if r.doc_id >= 500)
    assert got == [(504, 5), (504, 5), (505, 3)]


def test_without_grades_or_documents(spark):
    docs, grades, _ = corpus(spark)
    none = reading_levels(docs, spark.createDataFrame([], GRADE)).groupBy("reading_level").count().collect()
    assert [tuple(r)[1] for r in none] == [240] or sum(r["count"] for r in none) == 240
    assert reading_levels(spark.createDataFrame([], DOC), grades).count() == 0
    assert reading_levels(docs, spark.createDataFrame([(1, "a", None)], GRADE)).count() == 240


def test_cut_points(spark):
    rows = [(i, 100, float(g), g + d) for i, (g, d) in enumerate([(1, 0.0), (1, 0.2), (2, -0.1), (2, 0.3), (3, 0.0), (5, -0.2)])]
    cuts = cut_points(spark.createDataFrame(rows, "doc_id long, n_words int, grade double, score double"))
    assert 1.2 <= cuts[0] <= 1.9 and 2.3 <= cuts[1] <= 3.0 and cuts == sorted(cuts)


def test_words_and_sentences():
    assert marked_words("One two's three. No!\n\nA-\nbc 'd' 5 \x01") == ["one", "two's", "three", "\x01", "no", "\x01", "abc", "d"]
    assert marked_words("Über l'été. D") == ["über", "l'été", "\x01", "d"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 6), max_size=40), max_size=6))
def test_edges_against_brute_force(texts):
    value, weight = np.linspace(1, 5, 7), np.linspace(1, 2, 7)
    b = Batch.of(sentence_edges(texts, 2))
    got = b.values(value, weight, 0.5)
    at = 0
    for i, t in enumerate(texts):
        sentences, now = [], []
        for x in [*t, -1]:
            if x < 0:
                sentences, now = sentences + ([now] if len(now) >= 2 else []), []
            else:
                now.append(x)
        sets = [sorted(set(x)) for x in sentences]
        n = sum(map(len, sets))
        assert sorted(set(sum(sets, []))) == sorted(b.node[at : at + n][b.first[at : at + n]])
        at += n
        if not sets:
            assert np.isnan(got[i])
            continue
        # the middle half by counting a fine grid of places
        means = sorted((np.dot(weight[x], value[x]) / weight[x].sum(), len(x)) for x in sets)
        places = [m for m, k in means for _ in range(k * 4)]
        assert abs(got[i] - np.mean(places[n : 3 * n])) < 1e-9


def test_word_values_settle_to_the_harmonic_solution(spark):
    """At the end every word is the weighted mean of its documents: one more round changes nothing."""
    docs, grades, _ = corpus(spark)
    s = ReadingSettings(settled=1e-6)
    _, _, changes = propagate(document_word_graph(docs, grades, s), s)
    assert changes[-1] <= 1e-6 and len(changes) > 2 and all(b < a for a, b in zip(changes[1:], changes[2:]))


def test_propagation_reaches_words_that_no_graded_document_holds(spark):
    """Held-out agreement of documents that share words with graded ones only through other documents."""
    rng = random.Random(8)
    vocabulary = {level: [f"{'abc'[k]}{'xyz'[k] * (i % 3 + 1)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] for k, level in enumerate((1, 3, 5))}
    rows, grades, truth = [], [], {}
    for i in range(600):
        level = (1, 3, 5)[i % 3]
        part = i // 3 % 4  # a graded document has words of the first quarter, the others of two neighbouring ones
        lo = 0 if i < 60 else 30 * part
        words = vocabulary[level][lo : lo + (30 if i < 60 else 60)]
        rows.append((i, " ".join(" ".join(rng.choices(words, k=8)).capitalize() + "." for _ in range(10)), "en", None, None))
        if i < 60:
            grades.append((i, "a", level))
        else:
            truth[i] = level
    docs, graded = spark.createDataFrame(rows, DOC), spark.createDataFrame(grades, GRADE)

    def agreement(s):
        got = {r.doc_id: r.reading_level for r in reading_levels(docs, graded, s).collect()}
        # levels 2 and 4 have no grades here and lie next to the ones that do
        return sum(abs(got[i] - truth[i]) <= 1 for i in truth) / len(truth)

    once, settled = agreement(dataclasses.replace(ReadingSettings(), settled=99.0)), agreement(ReadingSettings())
    assert settled > 0.95 and settled > once + 0.3, (once, settled)
