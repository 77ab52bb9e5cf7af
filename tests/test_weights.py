"""The pool of five runs and the weight search, by plain loops."""

import random

from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import evaluation

NORMS = "query_pr long, pr_id long, vector_norm double, file_norm double, bm25_norm double"


def made(seed, queries=14):
    rng = random.Random(seed)
    # few distinct values, so that scores tie often
    return [(q, p, *(rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3))) for q in range(queries) for p in rng.sample(range(100, 160), rng.randrange(2, 25))]


def top(rows, q, weights, k):
    own = [(-round(v * weights[0] + f * weights[1] + b * weights[2], 6), p) for x, p, v, f, b in rows if x == q]
    return [p for _, p in sorted(own)[:k]]


def test_pool_of_five_runs(spark):
    rows = made(1)
    want = {(q, p) for q in range(14) for w in C.POOL_RUNS for p in top(rows, q, w, 6)}
    got = evaluation.pool_runs(spark.createDataFrame(rows, NORMS).repartition(5)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert evaluation.pool_runs(spark.createDataFrame([], NORMS)).collect() == []


def test_weight_search_by_plain_loops(spark):
    rows, rng = made(2), random.Random(3)
    grades = [(q, p, rng.choice([0, 1, 2, 2, None])) for q, p, *_ in rows if q != 4 and rng.random() < 0.6]
    grades += grades[:5] + [(0, 999, 2), (77, 100, 2)]  # repeats, a relevant change that is no candidate, a query without candidates
    relevant = {}
    for q, p, g in grades:
        if g == 2:
            relevant.setdefault(q, set()).add(p)
    want = {}
    for i in range(5):
        for j in range(5 - i):
            w = (i / 4, j / 4, (4 - i - j) / 4)
            halves = {True: [], False: []}
            for q, own in relevant.items():
                halves[q % 2 == 0].append(len(own & set(top(rows, q, w, 3))) / len(own))
            want[w] = [round(sum(h) / len(h), 6) for h in (halves[True], halves[False])] + [len(halves[True]), len(halves[False])]
    got = evaluation.weight_search(spark.createDataFrame(rows, NORMS).repartition(5), spark.createDataFrame(grades, "query_pr long, pr_id long, grade int"), F.col("query_pr") % 2 == 0, steps=4).collect()
    assert len(got) == len(want) == 15
    for r in got:
        tune, holdout, nt, nh = want[(r.w_vector, r.w_file, r.w_bm25)]
        assert (r.tune_queries, r.holdout_queries) == (nt, nh)
        assert abs(r.tune_recall - tune) < 2e-6 and abs(r.holdout_recall - holdout) < 2e-6
    best = max(r.tune_recall for r in got)
    assert [tuple(r)[:2] for r in got if r.chosen] == [max(tuple(r)[:2] for r in got if r.tune_recall == best)]


def test_weight_search_without_rows(spark):
    none = evaluation.weight_search(spark.createDataFrame([], NORMS), spark.createDataFrame([], "query_pr long, pr_id long, grade int"), F.lit(True), steps=2).collect()
    assert len(none) == 6 and not any(r.chosen for r in none) and all(r.tune_recall is None and r.tune_queries == 0 for r in none)
