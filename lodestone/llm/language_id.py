"""Language identification by word-first backoff.

A known word scores its log frequency in each language; an unseen word falls back to its character n-grams, longest
first, and takes the mean log frequency of those that are known. Only frequencies are learnt.

Learning takes a bounded sample, ``SAMPLE_ROWS`` labelled rows at most in expectation, as many of each language as there
are (so a rare language is learnt like a frequent one), chosen by a hash of the id. The model keeps ``MAX_WORDS`` words and
``MAX_GRAMS`` n-grams, each language's most frequent ones, so what goes out to the executors has a fixed bound.
Prediction reads every document whole, in one pass without a shuffle.

Words and n-grams are 64-bit hashes of their code points, so a batch of texts is scored in numpy: the words of all texts
at once, and the backoff once for each distinct unseen word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import _words
from lodestone.llm._util import crc_mod, discard, map_arrow, materialize, partitions, release

SAMPLE_ROWS = 10_000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST = 5
#: An unseen event's share of a language's words or n-grams, and what each step back costs (natural logs).
UNSEEN = 0.5
STEP_BACK = math.log(0.4)
SLICE_BYTES = 4_000_000
UNKNOWN = "und"
#: Stand before and after a word when its n-grams are taken.
BEGIN, END = 2, 3


@dataclass
class Model:
    """languages; for words (size 0) and n-grams by their length: sorted hashes, and log frequencies by language."""

    languages: list[str]
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)

    def known(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the rows of those in logs."""
        have = self.hashes.get(size)
        if have is None or not len(have):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(have, h), len(have) - 1)
        hit = have[at] == h
        return hit, at[hit]


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points, equal for equal spans wherever they stand."""
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _words._power("up", _words.BASE, len(points)), out=total[1:])
    return _words.mix((total[ends] - total[starts]) * _words._power("down", _words.INVERSE, len(points) + 1)[starts])


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words (runs of letters, lower case) of all texts: code points, starts, ends, hashes, and the text of each."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = letters()[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    begin = np.cumsum([0, *[len(t) + 1 for t in low]])
    return points, starts, ends, span_hashes(points, starts, ends), np.searchsorted(begin, starts, side="right") - 1


def padded(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, each between BEGIN and END: code points, starts, sizes."""
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    place = np.repeat(starts - begin - 1, sizes) + np.arange(sizes.sum())
    out = points[np.clip(place, 0, len(points) - 1)] if len(points) else np.zeros(0, np.uint32)
    out[begin], out[begin + sizes - 1] = BEGIN, END
    return out, begin, sizes


def grams(points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside each padded word, and the word of each."""
    many = np.maximum(sizes - n + 1, 0)
    word = np.repeat(np.arange(len(sizes)), many)
    at = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
    return span_hashes(points, at, at + n), word


def count_features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For words (0) and n-grams by length: distinct hashes and how often each stands in the texts."""
    points, starts, ends, h, _ = words_of(texts)
    distinct, first, many = np.unique(h, return_index=True, return_counts=True)
    yield 0, distinct, many
    shown = padded(points, starts[first], ends[first])
    for n in range(1, LONGEST + 1):
        g, word = grams(*shown, n)
        seen, at = np.unique(g, return_inverse=True)
        yield n, seen, np.bincount(at, many[word], len(seen)).astype(np.int64)


def train(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows whose text and language are not null; without any, the model has no language.

    Of each language the features most frequent in it are kept (ties by their hash), as many for each, so reruns agree.
    Repeated rows count again; texts without a letter teach nothing; very long texts are read whole; an empty table
    gives an empty model. Other columns are not read.
    """
    labelled = rows.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).filter("t is not null and l is not null")
    share = shares({r.l: r["count"] for r in labelled.groupBy("l").count().collect()}, sample_rows)
    if not share:
        return Model([])
    if cut := {lang: s for lang, s in share.items() if s < 1}:
        most = F.create_map(*[F.lit(x) for lang, s in cut.items() for x in (lang, int(s * 2**62))])
        place = F.shiftrightunsigned(F.xxhash64("i", F.lit("language")), 2)
        labelled = labelled.filter(place < F.coalesce(F.try_element_at(most, F.col("l")), F.lit(2**62)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch, "t", SLICE_BYTES):
                by: dict[str, list[str]] = {}
                for text, lang in zip(part.column("t").to_pylist(), part.column("l").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    for size, h, n in count_features(texts):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), size, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["l", "size", "f", "n"])

    # the sample is small: dealt out anew, since a table may be one file
    sample = labelled.select("t", "l").repartition(partitions(rows.sparkSession))
    counts = map_arrow(sample, count, "l string, size int, f long, n long").groupBy("f", "size", "l").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-counts")
    totals = {(r.l, r["size"]): r.n for r in counts.groupBy("l", "size").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return Model([])
    quota = F.when(F.col("size") > 0, MAX_GRAMS // len(languages)).otherwise(MAX_WORDS // len(languages))
    nth = F.row_number().over(Window.partitionBy("l", F.col("size") > 0).orderBy(F.desc("n"), "f", "size"))
    best = counts.withColumn("nth", nth).filter(F.col("nth") <= F.greatest(quota, F.lit(1))).select("f", "size").distinct()
    by = [F.sum(F.when(F.col("l") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
    kept = counts.join(best, ["f", "size"]).groupBy("f", "size").agg(*by).toArrow()
    model = Model(languages)
    f, size = kept.column("f").to_numpy().view(np.uint64), kept.column("size").to_numpy()
    n = np.stack([kept.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1)
    for s in range(LONGEST + 1):
        own = np.flatnonzero(size == s)
        own = own[np.argsort(f[own])]
        total = np.log([totals.get((lang, s), 0) + UNSEEN for lang in languages])
        model.hashes[s], model.logs[s] = f[own], np.log(n[own] + UNSEEN) - total
    discard(counts)
    release()
    return model


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows to take, so that all together are ``most`` and no language is cut below another."""
    left, out = most, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        own = min(n, left / (len(sizes) - k))
        out[lang] = own / n
        left -= own
    return out


def word_scores(model: Model, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log frequencies by language of distinct words: their own, or the mean of their longest known n-grams; 0 for a word
    without any."""
    out = np.zeros((len(h), len(model.languages)))
    hit, at = model.known(0, h)
    out[hit] = model.logs[0][at] if len(at) else 0
    left = np.flatnonzero(~hit)
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        g, word = grams(*padded(points, starts[left], ends[left]), n)
        hit, at = model.known(n, g)
        if len(at):
            many = np.bincount(word[hit], minlength=len(left))
            found = many > 0
            for k in range(len(model.languages)):
                total = np.bincount(word[hit], model.logs[n][at, k], len(left))
                out[left[found], k] = total[found] / many[found] + STEP_BACK * (LONGEST + 1 - n)
            left = left[~found]
    return out


def scores(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each whole text and its share of the posterior (equal priors). Ties go to the first by code point."""
    points, starts, ends, h, text = words_of(texts)
    if not len(h) or not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
    by = word_scores(model, points, starts[first], ends[first], distinct)
    total = np.stack([np.bincount(text, by[at, k], len(texts)) for k in range(len(model.languages))], axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    some = np.bincount(text, minlength=len(texts)) > 0
    names = [model.languages[k] if s else UNKNOWN for k, s in zip(total.argmax(axis=1).tolist(), some.tolist(), strict=True)]
    return names, np.where(some, share.max(axis=1) / share.sum(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns in keep, lang_pred, score for each row.

    Null texts and texts without a letter, and all texts if the model has no language: und, 0. Repeated rows are judged
    each on its own; a very long text is taken whole, alone; no rows in: no rows out. Of other columns only those in keep
    are read; they must not be called doc_id, lang_pred or score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    chosen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch, "_text", SLICE_BYTES):
                names, share = scores(part.column("_text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(share)], names=[*part.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_arrow(chosen, run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, lang_pred, score. Learns from rows whose crc32(id) mod 5 is not 0 (a null id
    counts as the empty text). Nulls, repeats, very long texts, empty tables and other columns as in train and predict."""
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
