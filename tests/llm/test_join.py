import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import sentence

from lodestone.llm import ngram_join as J

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d is None, d or 0, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.join(df).collect())


def edits(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [sentence(rng, rng.choice((3, 5, 9, 20, 60, 150, 400, 900))) for _ in range(80)]
    passage = sentence(rng, 50)
    for _ in range(60):
        t = rng.choice(texts)
        texts.append(rng.choice((t, t.upper(), edits(rng, t, 0.01), edits(rng, t, 0.03), edits(rng, t, 0.06), t + " " + sentence(rng, 4))))
    texts += [passage + " " + sentence(rng, rng.choice((5, 30, 100))) for _ in range(40)]
    texts += [edits(rng, sentence(random.Random(9), 120), 0.02) for _ in range(40)]
    return list(enumerate([*texts, None, "", "  "]))


def test_equals_brute_force(spark, corpus):
    assert run(spark, corpus) == brute(corpus)


def test_equals_brute_force_with_hot_codes(spark, corpus, monkeypatch):
    """With tiny limits nearly every shared code is hot and every block is small, so the other way does the work."""
    monkeypatch.setattr(J, "FEW", 2)
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "SIMILARITY", 75)
    assert run(spark, corpus) == brute(corpus)


def test_a_common_passage_with_uneven_extensions(spark):
    """All that two documents share is text that over HOT others carry too, and one has many codes of its own."""
    rng = random.Random(24)
    passage = sentence(rng, 184)
    texts = [passage + " " + sentence(rng, 75) for _ in range(240)]
    rows = list(enumerate([*texts, passage + " " + sentence(rng, 59), passage]))
    want = brute(rows)
    assert [c for *_, c in want] == [*range(241), 240]
    assert run(spark, rows) == want


def edited_pair(rng, n, similarity):
    """Two texts of about n words whose similarity lies close to the one given: one run of words is another in the second."""
    a = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    k = round((n - 4) * (1 - similarity) / (1 + similarity)) - 4
    at = rng.randrange(1, n - k)
    return " ".join(a), " ".join([*a[:at], *[f"x{rng.randrange(10**9)}" for _ in range(k)], *a[at + k :]])


def test_large_sets_around_the_threshold(spark):
    """Each pair is by itself near 0.75, so a single missed code would show; also chains of sizes across a band's end."""
    rng = random.Random(7)
    rows, k = [], 0
    for n in (500, 760, 1020, 1030, 1500, 2040, 2060, 3000, 5000):
        for similarity in (0.74, 0.748, 0.7499, 0.7501, 0.752, 0.76):
            for t in edited_pair(rng, n, similarity):
                rows.append((k, t))
                k += 1
        long = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        rows += [(k, " ".join(long)), (k + 1, " ".join(long[: n * 3 // 4 + 4])), (k + 2, " ".join(long[: n * 3 // 4 - 30]))]
        k += 3
    want = brute(rows)
    assert 0.3 < sum(d == c for _, d, _, c in want) / len(want) < 0.9
    assert run(spark, rows) == want


def test_codes_outnumber_what_two_linked_sets_can_differ_by():
    """Of two sets at the threshold the first codes always share one, whichever shingles count as common."""
    rng = np.random.default_rng(11)
    for n in [*range(1, 70), 127, 128, 191, 192, 400, 1023, 1024, 3000]:
        for _ in range(4):
            m = int(rng.integers(-(-3 * n // 4), n + 1))
            both = -(-75 * (n + m) // 175)
            pool = np.unique(rng.integers(0, 2**63, 2 * (n + m)).astype(np.uint64) << np.uint64(1))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
            common = np.sort(rng.choice(pool, len(pool) // 2, replace=False))
            for usual in (common[:0], common, np.sort(pool)):
                (x, few), (y, also) = J.parity_keys(a, usual), J.parity_keys(b, usual)
                assert not few and not also and len(np.intersect1d(x, y))


def test_sets_with_too_few_codes_are_held_against_all(spark):
    got = J.against_all(spark.createDataFrame([(k, 10, J.sketch(np.arange(k, k + 10, dtype=np.uint64)), k == 3) for k in (2, 3, 4, 5, 90)], "cls long, n long, sketch binary, short boolean"))
    assert sorted(map(tuple, got.collect())) == [(2, 3), (3, 4)]


def test_a_hot_code_of_many_components(spark, monkeypatch):
    """Short texts around one passage: most share codes, few link; the blocks of a code are buckets of their own."""
    monkeypatch.setattr(J, "FEW", 2)
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "BLOCK", 6)
    rng = random.Random(31)
    passage = sentence(rng, 40)
    rows = list(enumerate(passage + " " + sentence(rng, rng.choice((3, 8, 12, 14, 20))) for _ in range(120)))
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.join(awkward).collect())
    assert got == brute(rows)


def test_empty_table(spark, empty):
    assert J.join(empty).collect() == []


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 7, 64, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n * 3 // 4], rng.integers(0, 2**63, max(1, n // 5)).astype(np.uint64)]))
        rows = J.fold([J.sketch(a), J.sketch(b)])
        assert int(np.bitwise_count(rows[0] ^ rows[1]).sum()) <= len(np.setxor1d(a, b))


def test_folded_sketch_is_the_shorter_sketch():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    m = len(J.sketch(a)) * 8 // 2
    short = np.packbits((np.bincount((a & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()
    assert J.fold([J.sketch(a), short])[0].tobytes() == short


def test_groups_over_batches():
    rows = [(1, 10), (1, 11), (2, 12), (2, 13), (2, 14), (3, 15)]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in x]), pa.array([v for _, v in x])], names=["g", "v"]) for x in (rows[:1], rows[1:3], rows[3:4], rows[4:], rows[:0])]
    assert [(int(d["g"][0]), d["v"].tolist()) for d in J._groups(iter(batches), "g")] == [(1, [10, 11]), (2, [12, 13, 14]), (3, [15])]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 130)] + [(200, 201), (200, 200)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, **{k: 100 for k in range(101, 130)}, 201: 200}
