import re

import pytest

from lodestone.llm import license_scan as S


def brute(text, templates, t):
    """Every window that begins at a bigram of the template, of the three lengths, over the words of all lines."""
    words = [(x.lower(), i) for i, line in enumerate((text or "").split("\n")) for x in re.split("[^0-9A-Za-z]+", line) if x]
    g = [f"{a} {b}" for (a, _), (b, _) in zip(words, words[1:])]
    hits = []
    for k, v in templates.items():
        own = [f"{a} {b}" for a, b in zip(_words(v), _words(v)[1:])]
        for i, x in enumerate(g):
            if x not in own:
                continue
            for w in (max(1, 3 * len(own) // 4), len(own), 9 * len(own) // 8 + 1):
                a, b = set(g[i : i + w]), set(own)
                if (d := 2 * len(a & b) / (len(a) + len(b))) >= t:
                    hits.append((-d, i, k))
    hits.sort()
    best = hits[0] if hits else (None, None, None)
    return (best[2], -best[0] if hits else None, words[best[1]][1] if hits else None, best[1], sorted({h[2] for h in hits}))


def _words(s):
    return [x.lower() for x in re.split("[^0-9A-Za-z]+", s) if x]


def wrapped(text, n):
    w = text.split()
    return "\n".join("# " + " ".join(w[k : k + n]) for k in range(0, len(w), n))


TEXTS = [
    "x\nReleased under the MIT License.\ny", "released, UNDER: the mit license", "Licensed under the Apache License, Version 2.0. Really", "Licensed under the Apache License Version 2\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY NC 4.0",
    None, "", "\n\n", "the the the the the the", "This work is licensed under the GNU General Public License, version 2.", " ".join(S.TEMPLATES.values()), "word " * 30_000,
    wrapped(S.TEMPLATES["BSD-notice"], 6), "Some code. " + wrapped(S.TEMPLATES["GPL-3.0-notice"], 9) + " and more", "Copyright (c) 2024 Me\n\n" + wrapped(S.TEMPLATES["MIT-text"], 11) + "\nint main() {}",
    S.TEMPLATES["ISC-text"].replace("THE AUTHOR", "JANE DOE AND OTHERS"), wrapped(S.TEMPLATES["BSD-2-Clause-text"], 7) + "\n" + S.TEMPLATES["Zlib-text"],
]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_equals_brute_force(spark, threshold):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string, dice string")
    got = {r.doc_id: (r.license_id, r.dice, r.line_no, r.word_no, r.licenses) for r in S.scan(df, threshold=threshold).collect()}
    assert got == {k: brute(t, S.TEMPLATES, threshold) for k, t in enumerate([*TEXTS, TEXTS[0]])}


def test_notices_over_lines_and_whole_licences_are_found(spark):
    want = {11: "BSD-notice", 12: "GPL-3.0-notice", 13: "MIT-text", 14: "ISC-text", 15: "BSD-2-Clause-text"}
    got = {r.doc_id: r.license_id for r in S.scan(spark.createDataFrame([(k, TEXTS[k]) for k in want], "doc_id long, text string")).collect()}
    assert got == want


def test_no_match_lacks_all_anchors():
    for t in (0.5, 0.8, 1.0):
        for text in S.TEMPLATES.values():
            g = set(S.bigrams(S.template_words(text)))
            met = {x for x in g if set(x.split()) & set(S.anchors(list(g), t))}
            assert len(g) - len(met) < S.bounds(len(g), t)[0]


def test_bounds_prune_no_match():
    for t in (0.3, 0.5, 0.8, 0.95):
        for b in range(1, 60):
            low, high = S.bounds(b, t)
            for a in range(1, 200):
                if 2 * min(a, b) / (a + b) >= t:
                    assert low <= a <= high


def test_no_templates_awkward_and_empty(spark, awkward, empty):
    assert {r.license_id for r in S.scan(awkward, templates={}).collect()} == {None}
    assert len(S.scan(awkward).collect()) == awkward.count() and S.scan(empty).collect() == []
