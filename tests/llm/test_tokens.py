import numpy as np
import pytest
import tiktoken

from lodestone.llm import token_counts as K


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("t", pat_str=K.PATTERN, mergeable_ranks=K.read_vocabulary(None, K.VOCABULARY), special_tokens={})


def brute(encoding, parts, rule):
    text = "\n".join(parts)
    owner, n = [], 0
    for k, part in enumerate(parts):
        pieces = part.split("\n")
        for i, piece in enumerate(pieces):
            tail = "\n" if i < len(pieces) - 1 or k < len(parts) - 1 else ""
            owner += [n] * len((piece + tail).encode())
            n += 1
    counts, at, crossing = [0] * n, 0, 0
    ids = encoding.encode_ordinary(text)
    for t in ids:
        own = owner[at : at + len(encoding.decode_single_token_bytes(t))]
        at += len(own)
        crossing += len(set(own)) > 1
        counts[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
    return len(text), len(ids), crossing, counts


TEXTS = [(1, "one\n\n\ntwo  three\n \n\n x", "t1"), (2, None, "only"), (3, "", ""), (4, "😀é\n<|endoftext|>\nübergröße", None), (5, "a\r\n\r\nb", "z"), (5, "a\r\n\r\nb", "z"), (None, "x" * 3000 + "\n" + "y z " * 2000, "")]


@pytest.mark.parametrize("rule", K.RULES)
@pytest.mark.parametrize("fields", [("text",), ("title", "text")])
def test_equals_brute_force(spark, encoding, rule, fields):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, title string")
    got = sorted(((r.doc_id or 0, r.n_chars, r.n_tokens, r.n_crossing, r.section_tokens) for r in K.count_tokens(df, fields=fields, rule=rule).collect()))
    want = sorted(((d or 0, *brute(encoding, [{"text": t, "title": s}[f] or "" for f in fields], rule)) for d, t, s in TEXTS))
    assert got == want and all(sum(r[4]) == r[2] for r in got)


def test_rules_at_a_boundary():
    ends, bounds = np.array([2, 7, 9]), np.array([3, 6, 9])
    assert K.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert K.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2]
    assert K.attribute(ends, bounds, "most") [0].tolist() == [1, 1, 1]


def test_unknown_rule_awkward_and_empty(spark, awkward, empty):
    with pytest.raises(ValueError):
        K.count_tokens(awkward, rule="half")
    assert len(K.count_tokens(awkward).collect()) == awkward.count()
    assert K.count_tokens(empty).collect() == []


def test_vocabularies_of_one_size_are_told_apart(spark, tmp_path):
    import base64

    single = {bytes([k]): k for k in range(256)}
    paths = []
    for name, extra in (("a", b"ab"), ("b", b"bc")):
        paths.append(f"{tmp_path}/{name}")
        with open(paths[-1], "w") as f:
            f.writelines(f"{base64.b64encode(t).decode()} {r}\n" for t, r in (single | {extra: 256}).items())
    df = spark.createDataFrame([(1, "abab bc")], "doc_id long, text string").coalesce(1)
    assert [K.count_tokens(df, vocabulary=p).first().n_tokens for p in (*paths, paths[0], "file://" + paths[1])] == [5, 6, 5, 6]
