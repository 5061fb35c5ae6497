import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.packing import PackingSettings, container_report, default_vocabulary, limits_report, pack_classes, pack_documents, pack_group, packing_check, token_sizes

SIZES = "doc_id long, n_tokens int, loss_tokens int, piece string, container_id string"


def packed(spark, rows, s=PackingSettings()):
    return pack_documents(spark.createDataFrame([(i, n, x, "a", "b") for i, n, x in rows], SIZES), s).collect()


def test_every_document_once_and_split_only_above_the_capacity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), int(n)) for i, n in enumerate(rng.integers(0, 900, 3000))] + [(9001, 5000, 5000), (9002, 2048, 0), (9003, 0, 0), (9004, None, None), (9005, 4096, 0), (None, 7, 7), (7, 7, 7)]
    got = packed(spark, rows, PackingSettings(group_rows=700))
    total, pieces = {}, {}
    for r in got:
        total[r.container_id] = total.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert max(total.values()) <= 2048
    assert sorted(pieces[9001]) == [(1, 0, 2048), (2, 2048, 2048), (3, 4096, 904)] and len(pieces[9005]) == 2
    assert pieces[9003] == [(1, 0, 0)] and pieces[9004] == [(1, 0, 0)] and len(pieces[7]) == 2
    assert sum(len(p) for p in pieces.values()) == len(rows) + 3
    assert sum(total.values()) == sum(n or 0 for _, n, _ in rows)
    assert sum(total.values()) / 2048 / len(total) > 0.98


def test_limits_on_segments_and_loss(spark):
    s = PackingSettings(segments=3, loss_tokens=1000)
    got = packed(spark, [(i, 100, 100) for i in range(10)] + [(20 + i, 900, 900) for i in range(3)] + [(50, 1500, 1500)], s)
    per = {}
    loss = {50: 1.0}
    for r in got:
        c = per.setdefault(r.container_id, [0, 0, 0])
        c[0] += r.n_tokens
        c[1] += 1
        c[2] += int(r.n_tokens * loss.get(r.doc_id, 1.0))
    assert all(c[0] <= 2048 and c[1] <= 3 and c[2] <= 1000 for c in per.values())
    assert len([r for r in got if r.doc_id == 50]) == 2


def test_empty_table_and_report(spark):
    assert packed(spark, []) == []
    df = pack_documents(spark.createDataFrame([(1, 2000, 0, "", ""), (2, 48, 0, "", ""), (3, 10, 0, "", "")], SIZES))
    assert sorted((r.tokens, r.n_containers, r.unused) for r in container_report(df).collect()) == [(10, 1, 2038), (2048, 1, 0)]


def test_containers_depend_on_the_documents_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 2, int(n), int(n) // (1 + i % 3), "a", "b") for i, n in enumerate(rng.integers(0, 900, 2000))] + [(None, 50, 50, "a", "b")] * 40
    df, s = spark.createDataFrame(rows, SIZES), PackingSettings(group_rows=500)
    one, two = (sorted((tuple(r) for r in pack_documents(x, s).collect()), key=str) for x in (df.repartition(7), df.repartition(3, "n_tokens")))
    assert one == two and len(one) == len(rows)


def test_each_limit_binds(spark):
    rng = np.random.default_rng(5)
    sizes = [(i, n, n if i % 3 else 0, "", "") for i, n in enumerate(int(x) for x in rng.integers(20, 900, 3000))]
    for s, limit in ((PackingSettings(), "tokens"), (PackingSettings(segments=3), "segments"), (PackingSettings(loss_tokens=1000), "loss")):
        r = limits_report(pack_documents(spark.createDataFrame(sizes, SIZES), s), s).first()
        assert r.n_over == 0 and r[f"full_by_{limit}"] > 0.7 * r.n_containers, (limit, r)


def test_packing_check_finds_faults(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    good = [(1, 1, 0, 10, 0, 5), (2, 1, 0, 20, 0, 5)]
    bad = [(1, 1, 0, 10, 0, 5), (1, 2, 15, 10, 0, 5), (2, 1, 0, 2040, 0, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, piece int, token_start int, n_tokens int, loss_tokens int, container_id long")
    assert tuple(packing_check(docs, frame(good)).first()) == (2, 0, 0, 0) and tuple(packing_check(docs, frame(bad)).first()) == (2, 1, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=12))
def test_no_container_can_be_spared_trivially(items):
    tokens = np.array([a for a, _ in items])
    loss = np.minimum(tokens, np.array([b for _, b in items]))
    container, fill = pack_group(tokens, loss, PackingSettings(capacity=20, segments=4, loss_tokens=20))
    assert sorted(set(container)) == list(range(len(fill))) and (fill <= 20).all()
    for k in range(len(fill)):  # a later container's example never fitted into an earlier one
        room = 20 - fill[k], 4 - (container == k).sum(), 20 - loss[container == k].sum()
        for j in np.flatnonzero(container > k):
            assert tokens[j] > room[0] or room[1] < 1 or loss[j] > room[2]


def test_classes_with_large_counts_are_packed_by_pattern():
    out = pack_classes(np.array([[1500, 1, 0], [500, 1, 0]]), np.array([100_000, 100_000]), np.array([2048, 8, 2048]))
    assert len(out) == 100_000 and dict(out[0]) == {0: 1, 1: 1}


@pytest.mark.skipif(not os.path.exists(default_vocabulary()), reason="no vocabulary installed")
def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a count of cases", "en"), (2, None, "en"), (3, "", None), (4, "10 EA", "zxx"), (5, "x " * 50_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_tokens, r.loss_tokens) for r in token_sizes(df).collect()}
    assert got[2] == got[3] == (0, 0) and got[4][1] == 0 < got[4][0] and got[1][0] == got[1][1] > 2 and got[5][0] >= 50_000
