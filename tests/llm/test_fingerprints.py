import hashlib
import random

from conftest import sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fingerprints as P

TEXT = st.text(alphabet="abé😀", max_size=40)


@given(TEXT, TEXT)
@settings(deadline=None, max_examples=200)
def test_spans_and_extensions(x, y):
    a, b = P.Prefix(x), P.Prefix(y)
    for i in range(0, len(x) + 1, 3):
        for j in range(0, len(y) + 1, 3):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            assert P.extension(a, i, b, j) == n
            m = 0
            while i - m > 0 and j - m > 0 and x[i - m - 1] == y[j - m - 1]:
                m += 1
            assert P.extension(a, i, b, j, backward=True) == m
            assert P.equal_spans(a, i, b, j, 4) == (x[i : i + 4] == y[j : j + 4] and i + 4 <= len(x) and j + 4 <= len(y))


@given(TEXT, TEXT)
@settings(deadline=None, max_examples=200)
def test_likeness(x, y):
    a, b = P.fingerprint(P.Prefix(x)), P.fingerprint(P.Prefix(y))
    assert (a == b) == (x == y) and (P.likeness(a, b) == 1) == (x == y)
    assert 0 <= P.likeness(a, b) <= 1 and P.likeness(a, b) == P.likeness(b, a)


def test_likeness_is_the_common_ends(spark):
    rng = random.Random(1)
    text = sentence(rng, 500)
    other = P.edited(text, sentence(rng, 500))
    near = P.likeness(P.fingerprint(P.Prefix(text)), P.fingerprint(P.Prefix(other)))
    assert 0.65 <= near <= 0.76


def run(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in P.fingerprints(df).collect()))


def brute(rows):
    rows = sorted(((d if d is not None else -(1 << 63), d, t or "") for d, t in rows), key=lambda r: (r[0], r[2].encode()))
    out = []
    for k, (_, d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        e = P.edited(t, nxt)
        f, g, h = (P.fingerprint(P.Prefix(x)) for x in (t, e, nxt))
        out.append((d is None, d or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), P.likeness(f, g), P.likeness(f, h), f))
    return sorted(out)


def test_neighbours_across_ranges(spark):
    rng = random.Random(2)
    rows = [(k * 7 % 1001, sentence(rng, rng.randrange(30))) for k in range(300)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_awkward_one_and_none(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert run(awkward) == brute(rows)
    assert run(awkward.filter("doc_id = 7")) == brute([(7, "one two")])
    assert P.fingerprints(empty).collect() == []


def test_columns_by_plain_loops(spark):
    """The edited text, its hash and the common extensions, without the operator's own functions."""
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("aé😀b ") for _ in range(rng.randrange(60))) + ("x" * 400 if k % 9 == 0 else "")) for k in range(0, 120, 2)] + [(7, None), (9, "")]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted((d, t or "") for d, t in rows)

    def begin(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for k, (d, t) in enumerate(order):
        nxt, q, r = order[(k + 1) % len(order)][1], len(t) // 4, got[d]
        e = t[: len(t) - q] + nxt[:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.begin_edited, r.begin_next) == (begin(t, e), begin(t, nxt))
        assert (r.end_edited, r.end_next) == (begin(t[::-1], e[::-1]), begin(t[::-1], nxt[::-1]))
        assert (r.fingerprint == r.edited_fingerprint) == (t == e) == (r.near_edited == 1)
        n = max(len(t), len(e), 1)
        assert abs(r.near_edited - min(begin(t, e) + begin(t[::-1], e[::-1]), len(t), len(e)) / n) <= 4 / 32 + 1 / n or t == e


def test_ids_that_are_text(spark):
    rows = [("b", "two"), ("a", "one one one one"), (None, "zero"), ("c", None)]
    got = {r.doc_id: r.edited_sha256 for r in P.fingerprints(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["a"] == hashlib.sha256(b"one one one two").hexdigest() and len(got) == 4
