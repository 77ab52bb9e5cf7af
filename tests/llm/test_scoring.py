import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import sentence

from lodestone.llm import lm_scoring as L


def model_of(texts):
    """A model whose tables hold the texts."""
    data, offsets = joined(texts)
    text = L.Text(data, offsets)
    model, tally = L.Model(L.Code(dict(enumerate(np.bincount(text.pair, minlength=L.SYMBOLS**2).tolist())))), L.Tally()
    tally.add(model.code, text)
    for batch in tally.rows():
        r = batch.to_pylist()[0]
        at, n = L.unpacked(r["size"], r["data"])
        x = np.clip(np.round(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)) * L.STEPS), -127, 127)
        model.odds[r["part"] * L.RANGE + at] = np.where(x == 0, 1, x)
    return model


def joined(texts):
    raw = [t if isinstance(t, bytes) else t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_a_distribution_over_what_comes_next():
    """After any beginning, the probabilities of all bytes and of the end add up to one."""
    model = model_of(["the cat sat on the mat", "the dog sat", "a cat"] * 20)
    for begun in (b"", b"the c", b"zz\xff", b"x" * 40):
        total = sum(math.exp(next_symbol(model, begun, s)) for s in range(L.SYMBOLS))
        assert abs(total - 1) < 2e-3  # each bit is kept off 0 and 1 by 1e-5


def next_symbol(model, begun, symbol):
    """log P(symbol | begun), with the gains a segment begins with."""
    whole = begun + (bytes([symbol]) if symbol != L.END else b"")
    text = L.Text(*joined([whole]))
    l, many = L.lanes(model, text), model.code.length[text.pair]
    at, n = (int(many[:-2].sum()), int(many[-2])) if symbol != L.END else (int(many[:-1].sum()), int(many[-1]))
    out = 0.0
    for k in range(at, at + n):
        x = sum(model.weights[l.gate[k], i] * float(l.odds[i][k]) / L.STEPS for i in range(L.INPUTS))
        out += math.log(of_bit(model, l, k, x, 1 / (1 + math.exp(-x))))
    return out


def of_bit(model, l, k, mixed, p):
    spot = int((min(max(mixed, -L.REACH), L.REACH) + L.REACH) * ((L.BINS - 1) / 2 / L.REACH) + 0.5) + int(l.gate[k]) * L.BINS
    q = min(max((p + float(model.refined[spot])) / 2, 1e-5), 1 - 1e-5)
    return q if l.bit[k] else 1 - q


def plain_read(model, text):
    """The same bits one at a time, in plain loops: one lane after the other, gains followed block by block."""
    l = L.lanes(model, L.Text(*joined([text])))
    total = 0.0
    for first, size in zip(l.first, l.size, strict=True):
        gains = [1.0, 1.0]
        for b in range(first, first + size):
            moved = [0.0, 0.0]
            for k in range(b * L.BLOCK, (b + 1) * L.BLOCK):
                if l.bit[k] == L.FILL:
                    continue
                sums = [sum(float(model.weights[l.gate[k], i]) / L.STEPS * float(l.odds[i][k]) for i in own) for own in (range(L.LONG), range(L.LONG, L.INPUTS))]
                mixed = gains[0] * sums[0] + gains[1] * sums[1]
                p = 1 / (1 + math.exp(-mixed))
                total += math.log(of_bit(model, l, k, mixed, p))
                moved = [m + (int(l.bit[k]) - p) * x for m, x in zip(moved, sums, strict=True)]
            gains = [g + L.RATE * m for g, m in zip(gains, moved, strict=True)]
    return total


def test_equals_plain_loops():
    rng = random.Random(4)
    texts = [sentence(rng, n) for n in (3, 40, 900)] + ["", "é😀 mixed CASE", "a" * 3000]
    model = model_of(texts[:2] + ["other words here"])
    got = L.log_probability(model, *joined(texts))
    for g, t in zip(got, texts, strict=True):
        assert g == pytest.approx(plain_read(model, t), rel=1e-4)


def test_tables_equal_plain_counts():
    texts = ["abab abab", "ab", ""]
    code = L.Code({})
    t = L.Text(*joined(texts))
    tally = L.Tally()
    tally.add(code, t)
    want = [Counter() for _ in range(L.INPUTS)]
    for k in range(L.INPUTS):
        base = t.base(k)
        for i, pair in enumerate(t.pair):
            for s in range(code.start[pair], code.start[pair] + code.length[pair]):
                want[k][(int(base[i]) ^ int(code.node[s])) * 2 + int(code.bit[s])] += 1
    for k in range(L.INPUTS):
        at = np.flatnonzero(tally.tables[k])
        assert dict(zip(at.tolist(), tally.tables[k][at].tolist(), strict=True)) == dict(want[k])


def test_learning_equals_plain_loops():
    """One lane: weights after each bit, and their mean over the bits of each gate."""
    model, text = model_of(["some words to learn", "more words"]), "some more words to read"
    l = L.lanes(model, L.Text(*joined([text])))
    learner = L.Learner(model)
    learner.read(l)
    w, total, used = model.weights.astype(float), np.zeros((L.GATES, L.INPUTS)), np.zeros(L.GATES)
    for k in np.flatnonzero(l.bit != L.FILL):
        g, x = l.gate[k], np.array([float(o[k]) / L.STEPS for o in l.odds])
        w[g] += L.LEARN * (l.bit[k] - 1 / (1 + math.exp(-(w[g] @ x)))) * x / 21
        total[g] += w[g]
        used[g] += 1
    assert np.allclose(learner.total, total) and (learner.used == used).all() and learner.seen[1].sum() == (l.bit == 1).sum()


def test_pairs_equal_plain_counts():
    for texts in (["ab", "", "", "ba c"], [""], [], ["", "x"]):
        data, offsets = joined(texts) if texts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        text = L.Text(data, offsets)
        assert (L.pairs_of(data, offsets) == np.bincount(text.pair, minlength=L.SYMBOLS**2)).all()


def test_code_is_a_prefix_code():
    code = L.Code({L.END * L.SYMBOLS + 65: 1000, L.END * L.SYMBOLS + 66: 10})
    for before in (0, L.END):
        words = []
        for s in range(L.SYMBOLS):
            at, n = code.start[before * L.SYMBOLS + s], code.length[before * L.SYMBOLS + s]
            words.append("".join(map(str, code.bit[at : at + n])))
        assert sum(2.0 ** -len(w) for w in words) == pytest.approx(1)
        assert not any(b.startswith(a) for a, b in zip(sorted(words), sorted(words)[1:]))
    assert code.length[L.END * L.SYMBOLS + 65] == 1


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, key string, n int, h long")


def base_of(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    remainder = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    c = Counter(x for i, t in rows if remainder(i) != 2 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, remainder(i) == 2, len(tokens(t)), sum(x in c for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows), key=str)


@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_base_equals_plain_counts(spark, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    rng = random.Random(frequent)
    rows = [(k, sentence(rng, rng.randrange(1, 60))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "One ONE one é É"), (None, "no id"), (None, None), (7, "another text of seven"), rows[3], rows[3], (104, sentence(rng, 4000))]
    got = L.score(frame(spark, [(*r, 0.5, "x", 1, 2) for r in rows]).repartition(2)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base_of(rows)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_held_out_texts_are_told_from_noise(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 80) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)]
    held = [k for k in range(300, 900) if zlib.crc32(str(k).encode()) % 7 == 2][:40]
    rows += [(k, sentence(rng, 80)) for k in held[:20]]
    rows += [(k, "".join(rng.sample(t := sentence(rng, 80), len(t)))) for k in held[20:]]
    got = {r.doc_id: r for r in L.score(frame(spark, [(*r, 0.5, "x", 1, 2) for r in rows])).collect()}
    like, noise = [got[k].bits_per_byte for k in held[:20]], [got[k].bits_per_byte for k in held[20:]]
    assert max(like) < 2.5 < 4 < min(noise)


def test_no_rows_and_no_training_rows(spark):
    assert L.score(frame(spark, [])).count() == 0
    k = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = L.score(frame(spark, [(k, "some words", None, None, None, None)])).collect()
    assert [(x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(True, 3, 0, 0, 0.0)] and r[0].score < 0
