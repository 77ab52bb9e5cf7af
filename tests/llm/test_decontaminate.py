import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import sentence

from lodestone.llm import decontaminate as D

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    items = [(k, sentence(rng, rng.choice((1, 4, 13, 20, 40)))) for k in range(30)] + [(90, None), (91, "!!"), (3, "extra text of item three"), (92, "été à l'école")]
    docs = []
    for k in range(60):
        parts = [sentence(rng, rng.choice((0, 5, 200)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1] or ""
            w = " ".join(w.split()[: rng.choice((12, 13, 50))])
            parts += [rng.choice((w, w.upper(), w.replace(" ", ", ")))] * rng.choice((1, 3)) + [sentence(rng, 7)]
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (103, "ÉTÉ été À L'ÉCOLE"), (104, "été à l'école.")]
    got = D.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_blocks_of_a_large_benchmark_add_up(spark, monkeypatch):
    """Items in several blocks: hits of one document that overlap across blocks are one, columns kept come along."""
    rng = random.Random(5)
    text = sentence(rng, 60).split()
    items = [(k, " ".join(text[a : a + 20])) for k, a in enumerate((0, 10, 18, 40))] + [(9, sentence(rng, 30)), (10, "one")]
    docs = [(1, "pre " + " ".join(text) + " post", "x"), (1, "pre " + " ".join(text) + " post", "x"), (2, "clean words here", "y"), (3, None, "z"), (None, items[4][1] + " One.", "w")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, _c string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: repr((r.doc_id, r._c, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans], r.contaminated))
    whole = sorted(map(key, D.scan(d, b, keep=["_c"]).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    assert sorted(map(key, D.scan(d, b, keep=["_c"]).collect())) == whole
    assert sorted((tuple(r) for r in D.digest(d, b).collect()), key=repr) == brute([r[:2] for r in docs], items)


@pytest.mark.parametrize("size", [150, 5_000])
def test_blocks_over_rows_in_changing_order(spark, monkeypatch, size):
    """Rows dealt round robin come in another order whenever they are computed again."""
    rng = random.Random(size)
    items = [(k, sentence(rng, rng.randrange(3, 40))) for k in range(60)]
    docs = [(k, sentence(rng, 30) + (" " + items[k % 60][1] if k % 2 else "") + " " + sentence(rng, k % 50)) for k in range(400)]
    docs += docs[:5]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("_c", F.col("doc_id") * 2).repartition(7)
    monkeypatch.setattr(D, "BLOCK_BYTES", size)
    got = D.scan(d, spark.createDataFrame(items, "item_id long, text string"), keep=["_c"]).collect()
    assert all(r._c == 2 * r.doc_id for r in got)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in got), key=repr) == sorted(((x[0], x[1], x[2], x[3], x[5]) for x in brute(docs, items)), key=repr)


def test_phrases_are_flat_arrays():
    """Windows that repeat inside and across items, items of one id, short items, none."""
    rng = random.Random(8)
    items = [("a", "x " * 40), ("b", sentence(rng, 30)), ("c", "one two"), ("a", "one TWO"), ("d", None), ("e", ""), ("f", "One two")]
    p = D.Phrases(items)
    want: dict = {}
    for i, t in items:
        w = (t or "").lower().split()
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            want.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(i)
    assert {n: sorted(sorted(o) for o in x.values()) for n, x in want.items()} == {n: sorted(sorted(p.ids[o] for o in owners[a:z]) for a, z in zip(runs, runs[1:])) for n, (_, owners, runs) in p.by_length.items()}
    assert all(phrases.shape == (len(want[n]), n) for n, (phrases, _, _) in p.by_length.items())
    assert D.Phrases([]).by_length == {}


def test_a_very_long_document(spark):
    rng = random.Random(6)
    item = sentence(rng, 20)
    docs = [(1, sentence(rng, 150_000) + " " + item), (2, "word " * 200_000)]
    got = D.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, [(1, item)])


def test_spans_cover_the_hits(spark):
    item = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(1, "😀 Ünd " + item + ", end. " + item)], "doc_id long, text string")
    (r,) = D.scan(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    text = docs.first().text
    assert [text[s.start : s.end] for s in r.spans] == [item, item]
    assert D.remove_spans(text, [(s.start, s.end) for s in r.spans]) == "😀 Ünd , end. "


def test_awkward_and_empty(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "one two"), (None, "no id here")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((tuple(r) for r in D.digest(awkward, bench).collect()), key=repr) == brute(rows, [("1", "one two"), ("", "no id here")])
    assert D.digest(empty, bench).collect() == []
    none = D.digest(awkward, bench.filter("false")).collect()
    assert len(none) == awkward.count() and not any(r.n_hit or r.contaminated for r in none)


@pytest.mark.parametrize("sample", [1, 3, 8])
def test_index_finds_every_place(sample):
    rng = np.random.default_rng(4)
    text = np.concatenate([np.tile(rng.integers(1, 5, 7), 9), [0], rng.integers(1, 5, 200), [0]])
    index = D.FMIndex(text, 5, sample)
    for n in (1, 2, 3, 6, 13):
        phrases = np.unique(np.array([text[k : k + n] for k in range(len(text) - n) if 0 not in text[k : k + n]]), axis=0)
        low, high = index.search(phrases)
        for p, a, z in zip(phrases, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want
    low, high = index.search(np.array([[1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3]]))
    assert high[0] - low[0] == sum((text[k : k + 13] == [1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3]).all() for k in range(len(text) - 12))
