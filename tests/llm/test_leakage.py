import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.leakage import DOCUMENTS, LeakageSettings, build_index, find_leaks, search, segment_rows, segment_terms, tokens

DOC = "doc_id long, text string, lang string, h string, postings string"
ITEM = "item_id long, text string, suite string, share double"
ITEM_1 = "The driver Oswin left 417 crates of quenby tarts at gate 93 in Yelverholt before seal Q771 was torn by 4:25 and nobody signed."
ITEM_2 = "Nobody in Brackwick weighed the 688 jars of sorrel paste that Hollowell billed at $5,331.27 on the 29th of April under code Z118."
CLAUSE = "All goods remain the property of the seller until the invoice has been paid in full and the funds have cleared."


def filler(i):
    return f"The count of load L{i} was right and the clerk at dock D{i % 7} put sheet S{i} on the desk. We sent the bill to the store."


def docs(spark, *texts):
    rows = [(1000 + i, filler(i) + " " + CLAUSE, "en", "x", "y") for i in range(1500)] + [(i, t, "en", "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def leaks(spark, d, items=((1, ITEM_1, "s", 0.5), (2, ITEM_2 + " " + CLAUSE, "s", 0.5))):
    return sorted((r.doc_id, r.item_id) for r in find_leaks(d, spark.createDataFrame(list(items), ITEM)).collect())


def test_forms_of_a_leak(spark):
    half = ITEM_2.split(" that ")[0]
    d = docs(
        spark,
        filler(1) + ITEM_1 + filler(2),  # whole
        ITEM_1.upper().replace(" ", "\n"),  # retyped and rewrapped
        ITEM_1.replace("left", "dropped").replace("crates", "boxes"),  # reworded
        ITEM_1.replace("tarts at", "tarts, as we said on the phone, at"),  # interrupted
        "x " + ITEM_2 + " then " + ITEM_1,  # both, in another order
        half[:20],  # too little
        ITEM_1.replace("Oswin", "Edda").replace("417", "22").replace("quenby", "plum").replace("93", "5").replace("Yelverholt", "Marl").replace("Q771", "B2").replace("4:25", "9:10"),  # resembles
        CLAUSE, None, "", " ".join(filler(i) for i in range(1500)) + ITEM_2, ITEM_1, ITEM_1,
    )
    assert leaks(spark, d) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (10, 2), (11, 1), (12, 1)]


def test_empty_tables_and_items(spark):
    d = docs(spark, ITEM_1)
    assert leaks(spark, d, ((1, None, "s", 0.0), (2, "", "s", 0.0), (3, "...", None, None))) == []
    assert find_leaks(d, spark.createDataFrame([], ITEM)).count() == 0
    assert find_leaks(spark.createDataFrame([], DOC), spark.createDataFrame([(1, ITEM_1, "s", 0.0)], ITEM)).count() == 0


def test_blocks_of_items_give_the_same(spark):
    d = docs(spark, ITEM_1, ITEM_2)
    items = spark.createDataFrame([(1, ITEM_1, "s", 0.0), (2, ITEM_2, "s", 0.0), (2, ITEM_2, "s", 0.0)], ITEM)
    a = sorted((r.doc_id, r.item_id) for r in find_leaks(d, items).collect())
    b = sorted((r.doc_id, r.item_id) for r in find_leaks(d, items, LeakageSettings(block_items=1)).collect())
    assert a == b == [(0, 1), (1, 2), (1, 2)]


def test_against_brute_force(spark):
    """Documents with a random window of an item: found from fifteen tokens on, whatever stands around."""
    words = tokens(ITEM_2)
    texts, want = [], []
    for n in (4, 6, 15, 18, len(words)):
        for k in range(0, len(words) - n + 1, 3):
            texts.append(filler(n + k) + " " + " ".join(words[k : k + n]) + " " + filler(k))
            if n >= 15:
                want.append((len(texts) - 1, 2))
    got = leaks(spark, docs(spark, *texts))
    long = lambda d: len([w for w in tokens(texts[d]) if w in words]) >= 6
    assert len([x for x in got if x in want]) >= 0.9 * len(want) and all(long(d) for d, _ in got)


@settings(max_examples=50)
@given(st.lists(st.lists(st.sampled_from("a bb c12 dd é".split()), min_size=1, max_size=30), min_size=1, max_size=8))
def test_postings_round_trip(texts):
    rows = segment_rows(7, list(range(len(texts))), texts, [b"%08d" % i for i in range(len(texts))], 3)
    whole = [w for t in texts for w in t]
    back = [None] * len(whole)
    for bucket, segment, terms, sizes, docs, at in rows:
        if bucket == DOCUMENTS:
            assert list(np.frombuffer(terms, np.int64)) == list(range(len(texts)))
            continue
        size, n, delta = (np.frombuffer(x, np.int32) for x in (sizes, docs, at))
        k = 0
        for w, x, y in zip(segment_terms(terms), size, n):
            for p in np.cumsum(delta[k : k + x]):
                back[p] = w
            k += x
            assert y == sum(w in t for t in texts)
    assert back == whole


def random_corpus(seed, background, n_items, length):
    rng = np.random.default_rng(seed)
    words = [f"w{i:x}q" for i in range(3000)]
    share = 1 / np.arange(10, 3010)
    text = lambda n: list(rng.choice(words, n, p=share / share.sum()))
    return rng, text, [text(80) for _ in range(background)], [text(length) for _ in range(n_items)]


def found_in(spark, texts, items):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}


@pytest.mark.parametrize(("background", "n_items", "copies"), [(2000, 400, (20, 80, 120, 200, 1000)), (200, 40, (5,)), (10, 2, (60,))])
def test_an_item_is_found_however_widely_it_is_spread(spark, background, n_items, copies):
    _, text, texts, items = random_corpus(1, background, n_items, 60)
    want = set()
    for k, n in enumerate(copies):
        want |= {(len(texts) + i, k) for i in range(n)}
        texts += [text(20) + items[k] + text(20) for _ in range(n)]
    assert found_in(spark, texts, items) == want


def test_reworded_items_and_passages(spark):
    rng, text, texts, items = random_corpus(2, 2000, 200, 60)
    want = {}
    for k, t in enumerate(items):
        for kind, passage, swapped in (("16", t[20:36], 1), ("20", t[20:40], 1), ("25", t[10:35], 1), ("1 in 8", t, 8), ("1 in 6", t, 10)):
            p = list(passage)
            for at in rng.choice(len(p), swapped, replace=False):
                p[at] = "changed"
            want[len(texts), k] = kind
            texts.append(text(15) + p + text(15))
    got = found_in(spark, texts, items)
    assert got <= set(want)
    for kind in ("16", "20", "25", "1 in 8", "1 in 6"):
        mine = {x for x, y in want.items() if y == kind}
        assert len(mine & got) >= 0.9 * len(mine), kind


def test_a_passage_that_two_items_share_is_found(spark):
    _, text, texts, items = random_corpus(3, 300, 20, 60)
    items[1][10:40] = items[0][10:40]
    texts.append(text(9) + items[0][12:38] + text(9))
    assert found_in(spark, texts, items) == {(300, 0), (300, 1)}


def test_the_kinds_and_one_index_for_two_searches(spark):
    d = docs(spark, ITEM_1, ITEM_1.replace("left", "dropped").replace("gate", "door").replace("was", "got"))
    index = build_index(d, LeakageSettings(segment_tokens=500))
    for item, want in ((ITEM_1, [(0, "exact"), (1, "proximity")]), (ITEM_2, [])):
        got = search(index, spark.createDataFrame([(1, item, "s", 0.0)], ITEM)).collect()
        assert sorted((r.doc_id, r.kind) for r in got) == want


def test_null_ids(spark):
    d = spark.createDataFrame([(None, ITEM_1, "en", "x", "y")], DOC)
    assert [tuple(r)[:2] for r in find_leaks(d, spark.createDataFrame([(None, ITEM_1, "s", 0.0)], ITEM)).collect()] == [(None, None)]


def test_tokens():
    assert tokens("Owed $8,679.09 at 3:25, re-\nopened ﬁle") == ["owed", "867909", "at", "325", "reopened", "file"]
    assert tokens(None) == [] and np.array_equal(tokens("..."), [])
    with pytest.raises(AttributeError):
        tokens(5)
