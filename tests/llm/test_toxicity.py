import random

import numpy as np
from conftest import sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import toxicity as X


def brute(s):
    """All maximal scoring segments by definition: the best of a stretch, then the same left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), -i, (i, j)) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    i, j = best[3]
    return [*brute(s[:i]), (i, j, best[0]), *[(a + j, b + j, x) for a, b, x in brute(s[j:])]]


@given(st.lists(st.integers(-4, 4), max_size=14))
@settings(deadline=None, max_examples=400)
def test_segments_equal_the_definition(s):
    got = X.segments(np.array(s, float))
    assert sum(x for _, _, x in got) == sum(x for _, _, x in brute(s))
    assert [x for _, _, x in got] == [float(sum(s[a:b])) for a, b, _ in got] and all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))
    assert max((x for _, _, x in got), default=0) == max((x for _, _, x in brute(s)), default=0)


def make(spark, n=600):
    rng, docs, labels = random.Random(1), [], []
    for k in range(n):
        y = k % 4 == 0
        t = sentence(rng, rng.randrange(20, 120)).split()
        if y:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(("nastyword", "vilething", "grotsk" + rng.choice("abcdefgh") * 3)))
        docs.append((k, " ".join(t), "x", 0.1))
        labels.append((k, 1, int(y)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_stems_and_finds_passages(spark):
    docs, labels = make(spark)
    got = X.rate(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    model = X.fit(docs, labels)
    assert "nastyword" in model.by_feature and any(f.startswith("grot") and f.endswith("*") for f in model.by_feature)
    text = "calm " * 300 + "nastyword vilething nastyword " + "calm " * 300
    (r,) = X.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(p.start, p.end) for p in r.passages] == [(300, 303)] and r.predicted == 1


def test_p_values_fall_with_score_and_rise_with_length():
    m = X.Model(decay=1.5, k=0.02)
    assert m.p_value(5, 100) > m.p_value(8, 100) and m.p_value(5, 100) < m.p_value(5, 10_000) and m.p_value(0, 5) == 1
    assert m.evidence(400, 10) > m.evidence(40, 10) > m.evidence(4, 10)


def test_awkward_without_labels_and_empty(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in X.rate(awkward, none).collect()} == {0}
    some = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (3, 0, 0), (None, 0, 1), (7, 0, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(X.rate(awkward, some).collect()) == awkward.count()
    assert X.rate(empty, some).collect() == []


def test_held_out_rows_of_the_table(spark):
    """Ranking and decisions on rows that taught nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = X.rate(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in clean)
    assert len(toxic) > 50 and above / (len(toxic) * len(clean)) > 0.95
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic) and sum(r.predicted for r in clean) < 0.06 * len(clean)


def test_scores_by_plain_loops(spark):
    """Evidence and probability of whole documents from the model's weights, one token after the other."""
    import math

    docs, labels = make(spark, 300)
    model = X.fit(docs, labels)

    def weight(token):
        words, run = [], ""
        for c in token.lower() + " ":
            if c.isalpha():
                run += c
            elif run:
                words.append(run)
                run = ""
        names = words + [w[:k] + "*" for w in words for k in range(4, 9) if k < len(w)]
        return max([model.by_feature.get(f, -0.05) for f in names], default=-0.05)

    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    for r in docs.collect():
        s, best, run = [weight(t) for t in r.text.split()], 0.0, 0.0
        for x in s:
            run = max(0.0, run + x)
            best = max(best, run)
        tail = model.k * len(s) * math.exp(-model.decay * best)
        evidence = 0.0 if best <= 0 else -math.log(-math.expm1(-tail)) if tail > 1e-13 else -math.log(tail)
        x = math.log1p(max(0.0, evidence))
        assert abs(got[r.doc_id] - (0.998 * float(np.interp(x, *model.curve)) + 0.002 * x / (1 + x))) < 1e-9


def test_copies_and_very_long_texts(spark):
    docs, labels = make(spark, 300)
    model = X.fit(docs, labels)
    text = "calm " * 200_000 + "nastyword vilething nastyword"
    rows = X.score(spark.createDataFrame([(1, text), (1, text), (2, "nastyword")], "doc_id long, text string"), model).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1 and all(p.start == 200_000 for r in rows if r.doc_id == 1 for p in r.passages)
