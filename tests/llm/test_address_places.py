import itertools
import random

from ledgerlens.llm.address import components, same_places, settle, settle_here


def test_rounds_do_not_multiply_the_plan_s_estimates(spark):
    # a chain takes several rounds; each joined the estimates of the last ones, to numbers of many thousand bits that the driver held
    nodes = spark.range(200).withColumnRenamed("id", "node")
    labels = components(nodes, spark.range(199).selectExpr("id AS a", "id + 1 AS b"))
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**100
    assert {r.comp for r in labels.collect()} == {0} and labels.count() == 200


def test_settled_here_or_by_rounds(spark):
    rng = random.Random(11)
    lacks, links, vetoes = {}, [], []
    for first in range(0, 300, 10):  # small graphs, so that each rule has its cases
        own = range(first, first + 10)
        lacks |= {n: rng.choice((0, 0, 0, 1, 2, 3)) for n in own}
        for a, b in itertools.combinations(own, 2):
            if (x := rng.random()) < 0.22:
                links.append((a, b, rng.choice((0.7, 1.0))))
            elif x < 0.26:
                vetoes.append((a, b, rng.choice((1, 2))))
    got = settle(spark.createDataFrame(list(lacks.items()), "node long, lacks int"), spark.createDataFrame(links, "a long, b long, score double"), spark.createDataFrame(vetoes, "a long, b long, veto int"))
    here = settle_here(lacks, links, tuple(zip(*vetoes)))
    assert {r.node: r.comp for r in got.collect()} == here
    assert 0 < len(here) < len(lacks)  # some leave for good


def test_texts_of_one_number_over_several_batches(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        texts = [t for n in (12, 13, 14) for t in (f"{n} Elm Lane, Meadby IL 61553", f"{n} ELM LN., MEADBY IL", f"{n} elm lane; 61553", f"Fernhollow Foods DC {n}, {n} Elm Ln, Meadby", f"Fernhollow Foods #{n}, Meadby IL")]
        got = same_places(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(map(tuple, got)) == sorted(tuple(sorted(p)) for k in range(0, 15, 5) for p in itertools.combinations(texts[k : k + 5], 2))
