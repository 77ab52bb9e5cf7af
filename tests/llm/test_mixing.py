import re

import pytest

from lodestone.llm import mixing as M


def brute_targets(sizes):
    """sizes: source -> words. Deals out what is left by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_contract(spark, block):
    rows = [(k, f"s{k % 5}" if k % 11 else None, " ".join(["w"] * (k * k % 97))) for k in range(300)] + [(500, "tiny", "x"), (501, "void", ""), (502, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mix(docs, block_words=block).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, M.mix(docs, block_words=block).collect()))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: int(t + 0.5) for s, t in want.items()}


def test_block_size_changes_nothing_but_the_schedule(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "w " * (k % 50)) for k in range(200)], "doc_id long, source string, text string")
    a, b = ({(r.doc_id, r.taken) for r in M.mix(docs, block_words=n).collect()} for n in (5, 64))
    assert a == b


def test_schedule_is_spread_out(spark):
    """Any stretch of the schedule holds each source in proportion, within a few slots."""
    sizes = spark.createDataFrame([("a", 40_000), ("b", 30_000), ("c", 30_000)], "source string, source_size long")
    share = M.allot(M.targets(sizes), 100)
    ranks = [r["rank"] for r in M.slots(share, 100).orderBy("slot").collect()]
    total = len(ranks)
    for k in (1, 2, 3):
        part = ranks.count(k) / total
        for a in range(0, total - 128, 128):
            assert abs(ranks[a : a + 128].count(k) - 128 * part) < 16


def test_words_are_counted_as_defined(spark):
    text = "a\u00a0b c\td\x1ce\n\nf\x0bg"
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    assert M.mix(docs).first()["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_awkward_and_empty(spark, awkward, empty):
    got = M.mix(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert M.mix(empty).collect() == []
