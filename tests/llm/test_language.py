import math
import random

import pytest

from lodestone.llm import language_id as L

SAMPLES = {"en": "the cat sat on the mat and the dog ran with them through this garden", "fr": "le chat est dans la maison avec les enfants et une pomme pour nous", "de": "der hund ist nicht mit dem kind und das haus von mir auch"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, t, lang) for k in range(4) for lang, t in SAMPLES.items()] + [(90, None, "en"), (91, "ignored words", None)]
    return L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_known_words_then_shorter_ngrams(spark, model):
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, "the dog and the cat"), (2, "LE CHAT, les ENFANTS!"), (3, "gardening throughout"), (4, "kindhaus nichtig"), (5, None), (6, "123 -- ...  !"), (7, ""), (8, "½ ² 五 ")]
    got = {r.doc_id: r for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in range(1, 8)] == ["en", "fr", "en", "de", "und", "und", "und"] and got[8].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == 0


def test_digits_of_any_script_are_no_letters(spark, model):
    rows = [(1, "½ ² ٣"), (2, "² a")]
    got = {r.doc_id: r.lang_pred for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == "und" and got[2] != "und"


def runs(text):
    """Words: runs of letters, lower-cased."""
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def by_hand(train, texts, most=None):
    """The whole method over strings and plain dictionaries."""
    counts, languages = {}, sorted({lang for t, lang in train if t is not None and lang is not None and runs(t)})
    for t, lang in train:
        if t is None or lang is None:
            continue
        for w in runs(t):
            for f in [(0, w), *[(n, f"<{w}>"[k : k + n]) for n in range(1, 6) for k in range(len(w) + 3 - n)]]:
                counts.setdefault(f, dict.fromkeys(languages, 0))[lang] += 1
    totals = {(n, lang): sum(c[lang] for (m, _), c in counts.items() if m == n) for n in range(6) for lang in languages}

    def log(f, lang):
        return math.log(counts[f][lang] + 0.5) - math.log(totals[f[0], lang] + 0.5)

    def score(w, lang):
        if (0, w) in counts:
            return log((0, w), lang)
        for n in range(5, 0, -1):
            known = [(n, g) for k in range(len(w) + 3 - n) if (n, (g := f"<{w}>"[k : k + n])) in counts]
            if known:
                return sum(log(f, lang) for f in known) / len(known) + math.log(0.4) * (6 - n)
        return 0.0

    out = []
    for t in texts:
        if not runs(t) or not languages:
            out.append(("und", 0.0))
            continue
        total = {lang: sum(score(w, lang) for w in runs(t)) for lang in languages}
        best = max(languages, key=lambda x: total[x])
        out.append((best, 1 / sum(math.exp(v - total[best]) for v in total.values())))
    return out


def test_equals_the_method_by_hand(spark):
    rng = random.Random(8)
    stock = {"aa": "kado miru tesa kami rudo", "bb": "kado brin tosk amel zuri", "cc": "ñandú über façade Ωmega ἀρχή"}
    train = [(" ".join(rng.choice(w.split()) + rng.choice(("", "s", "en", "-x")) for _ in range(12)), lang) for lang, w in stock.items() for _ in range(9)]
    train += [(None, "aa"), ("unlabelled words", None), ("12 34", "dd"), train[0], train[0]]
    texts = [" ".join(rng.choice(" ".join(stock.values()).split()) + rng.choice(("", "en", "qq")) for _ in range(k)) for k in (1, 2, 5, 30, 4000)]
    texts += ["qqqq ŵŷ", "a", "½ ²", "", None, "İSTANBUL KADO", "kado" * 9000]
    model = L.train(spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(train)], "doc_id long, text string, lang string"))
    got = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, share) in zip(got, by_hand(train, texts), strict=True):
        assert (r.lang_pred, r.score) == (lang, pytest.approx(share, rel=1e-6))


def test_a_rare_language_is_learnt_at_any_size(spark, monkeypatch):
    """The sample is dealt by language, and no number of rows makes it empty."""
    assert L.shares({"a": 10, "b": 10**12, "c": 10**6}, 1000) == {"a": 1.0, "b": 495 / 10**12, "c": 495 / 10**6}
    assert int(L.shares({"a": 10**15}, 10_000)["a"] * 2**62) > 0
    rows = [(k, SAMPLES["en"], "en") for k in range(2000)] + [(5000 + k, SAMPLES["fr"], "fr") for k in range(3)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=100)
    assert model.languages == ["en", "fr"]


def test_the_model_has_a_bound_and_each_language_its_share(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", 6)
    monkeypatch.setattr(L, "MAX_GRAMS", 9)
    rows = [(k, SAMPLES["en"], "en") for k in range(50)] + [(90, SAMPLES["fr"], "fr"), (91, SAMPLES["de"], "de")]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.hashes[0]) <= 6 and sum(len(model.hashes[n]) for n in range(1, 6)) <= 9
    (r,) = L.predict(spark.createDataFrame([(1, "chat chat chat pomme est dans")], "doc_id long, text string"), model).collect()
    assert r.lang_pred == "fr"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    j = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(j) > 100 and sum(r.lang == r.lang_pred for r in j) >= 0.98 * len(j)


def test_awkward_and_empty(spark, awkward, empty):
    got = L.identify(awkward).collect()
    assert len(got) == awkward.count() and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert L.identify(empty).collect() == []
