"""Toxicity by maximum-scoring segments.

Learning: the words of toxic and other documents are counted by document; each gets its log-odds under a Dirichlet prior,
drawn towards zero by ``Z`` standard errors, and scores if ``LEAST`` is left. Then the same is done for the beginnings of
the words that do not score themselves, so a stem that toxic words share is found, and a toxic word lends nothing to
words that begin alike. Every other token costs ``GAP``.

Scoring: the linear-time search for all maximal scoring segments (disjoint, each the best around it) runs over the whole
token sequence. A segment's significance follows the extreme-value law of maximal segments: for n tokens,
P(best >= s) = 1 - exp(-K n exp(-lambda s)), where lambda solves E[exp(lambda score)] = 1 over the tokens of clean text
and K matches how often clean text has segments. The document's evidence is -ln P of its best segment; a rising curve,
fitted on labelled rows apart from those that gave the weights, turns evidence into a probability.

The classifier is fitted on at most about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, chosen by a hash of the id, and
keeps ``MAX_FEATURES`` features. Scoring reads every document whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._util import batches_of, crc_mod, discard, map_arrow, map_pandas, materialize
from lodestone.llm._words import slices

TOXIC_ROWS = 6_000
CLEAN_ROWS = 12_000
MAX_FEATURES = 100_000
MIN_ROWS = 3
#: One labelled row in so many calibrates and gives no counts.
CALIBRATE = 4
PRIOR = 0.5
Z = 2.5
LEAST = 1.0
GAP = -0.05
THRESHOLD = 0.3
SIGNIFICANT = 0.01
SHORTEST, LONGEST = 4, 8
CACHE = 200_000
SLICE_BYTES = 4_000_000
PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
LETTERS = re.compile(r"[^\W\d_]+")


def beginnings(word: str) -> list[str]:
    """The beginnings of a word, marked by a star."""
    return [word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)]


def features(token: str) -> list[str]:
    """The words of a token and their beginnings."""
    words = LETTERS.findall(token.lower())
    return words + [b for w in words for b in beginnings(w)]


class Weights(dict):
    """The score of a token: that of its strongest feature, or GAP. Filled as tokens come; see trim()."""

    def __init__(self, by_feature: dict[str, float]):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, token: str) -> float:
        w = max((self.by_feature.get(f, GAP) for f in features(token)), default=GAP)
        self[token] = w
        return w

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


@dataclass
class Model:
    by_feature: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    k: float = 1e-3
    curve: tuple[list[float], list[float]] = ((0.0, 4.0), (0.05, 0.95))

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.decay * score)) if score > 0 else 1.0

    def evidence(self, best: float, n: int) -> float:
        """-ln P of the best segment; from the tail's form where P is too small for a double."""
        if best <= 0:
            return 0.0
        log_e = math.log(self.k * max(n, 1)) - self.decay * best
        return -log_e if log_e < -30 else -math.log(max(self.p_value(best, n), 1e-300))

    def probability(self, evidence: float) -> float:
        """Along the calibration curve, with a slight rise of its own so that more evidence never ties with less."""
        x = math.log1p(max(0.0, evidence))
        return 0.998 * float(np.interp(x, *self.curve)) + 0.002 * x / (1 + x)


def segments(scores: list[float] | np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time; runs of tokens that do not score
    are taken in one step."""
    s = np.asarray(scores, np.float64)
    at = np.flatnonzero(s > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i in at.tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, z, float(r - left)) for a, z, left, r in stack]


def labelled(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[DataFrame, tuple[float, float]]:
    """(t, y, cal): texts of a bounded sample of the labelled rows; and how many rows a clean and a toxic one stand for. A
    document with several labels is toxic if any is; null labels are left out."""
    y = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter("i is not null and y is not null")
    y = y.groupBy("i").agg((F.max("y") > 0).alias("y"))
    n = {r.y: r["count"] for r in y.groupBy("y").count().collect()}
    lot = F.shiftrightunsigned(F.xxhash64("i", F.lit("toxicity")), 2)
    share = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((True, toxic_rows), (False, clean_rows))}
    y = y.filter(lot < F.when(F.col("y"), int(share[True] * 2**62)).otherwise(int(share[False] * 2**62)))
    # at most about toxic_rows + clean_rows ids, so their size is bounded
    own = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).filter("t is not null").join(F.broadcast(y), "i")
    # copies of a text count once, or what they happen to hold would look frequent
    own = own.groupBy("t").agg(F.max("y").cast("int").alias("y"))
    cal = F.pmod(F.xxhash64("t", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    return own.select("t", "y", cal.alias("cal")), (1 / share[False], 1 / share[True])


def count_by_row(rows: DataFrame, known: set[str] | None = None, only: set[str] | None = None) -> DataFrame:
    """(f, n): in how many rows each word occurs, or with known each beginning of a word that is not known; of those
    in only, if given."""
    shared = rows.sparkSession.sparkContext.broadcast((known, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        known, only = shared.value
        for batch in batches:
            for text in batch.column("t").to_pylist():
                found = set(LETTERS.findall(text.lower()))
                if known is not None:
                    found = {b for w in found - known for b in beginnings(w)}
                held.update(found if only is None else found & only)
                if len(held) > 300_000:
                    yield from batches_of(held.items(), ["f", "n"], [pa.string(), pa.int64()])
                    held.clear()
        yield from batches_of(held.items(), ["f", "n"], [pa.string(), pa.int64()])

    return map_arrow(rows.select("t"), run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))


def log_odds(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds ratio under a Dirichlet prior, less Z standard errors; what is below LEAST is left out."""
    out = {}
    for f, a in toxic.items():
        b = clean.get(f, 0)
        p = PRIOR + PRIOR * (a + b) / max(1, n_toxic + n_clean)
        odds = math.log((a + p) / (n_toxic + 2 * PRIOR - a + p)) - math.log((b + p) / (n_clean + 2 * PRIOR - b + p))
        w = odds - Z * math.sqrt(1 / (a + p) + 1 / (b + p))
        if w >= LEAST:
            out[f] = w
    return out


def train(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Fits the model on labelled rows of docs (doc_id, text) and labels (doc_id, toxic). Without toxic or without clean
    rows nothing scores, and every document gets the prior's low probability."""
    sample, weight = labelled(docs, labels, toxic_rows, clean_rows)
    rows = materialize(sample, "toxicity-sample")
    n = {(r.y, r.cal): r["count"] for r in rows.groupBy("y", "cal").count().collect()}
    n_toxic, n_clean = n.get((1, False), 0), n.get((0, False), 0)
    if not n_toxic or not n_clean:
        return Model()

    def weigh(known: set[str] | None) -> dict[str, float]:
        seen = count_by_row(rows.filter("y = 1 and not cal"), known).filter(F.col("n") >= MIN_ROWS)
        toxic = {r.f: r.n for r in seen.orderBy(F.desc("n"), "f").limit(MAX_FEATURES).collect()}
        clean = {r.f: r.n for r in count_by_row(rows.filter("y = 0 and not cal"), known, set(toxic)).collect()}
        return log_odds(toxic, clean, n_toxic, n_clean)

    words = weigh(None)
    model = Model(words | weigh(set(words)))
    tail = tail_counts(rows.filter("y = 0 and not cal"), model)
    model.decay, model.k = extreme_value(tail)
    model.curve = calibrate(rows.filter("cal"), model, weight)
    discard(rows)
    return model


def tail_counts(clean: DataFrame, model: Model) -> dict[float, list[int]]:
    """Score (to one decimal) -> how many tokens of clean text have it, and how many segments start with a total of it."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, tokens, found = Weights(shared.value.by_feature), Counter(), Counter()
        for batch in batches:
            for text in batch["t"]:
                scores = [weights[w] for w in text.split()]
                tokens.update(round(x, 1) if x > 0 else GAP for x in scores)
                found.update(round(x, 1) for _, _, x in segments(scores))
                weights.trim()
        yield pd.DataFrame([(x, tokens[x], found[x]) for x in tokens.keys() | found.keys()], columns=["x", "t", "s"])

    out = map_pandas(clean.select("t"), run, "x double, t long, s long").groupBy("x").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    return {r.x: [r.t, r.s] for r in out.collect()}


def extreme_value(tail: dict[float, list[int]]) -> tuple[float, float]:
    """lambda and K of clean text. Half a token of the lowest positive score stands for what was not seen."""
    tokens = {x: float(t) for x, (t, _) in tail.items() if t}
    positive = [x for x in tokens if x > 0]
    lowest = min(positive, default=1.0)
    tokens[lowest] = tokens.get(lowest, 0.0) + 0.5
    tokens[GAP] = tokens.get(GAP, 0.0) + 1.0
    n = sum(tokens.values())
    low, high = 1e-6, 1.0
    mean = lambda k: sum(t / n * math.exp(min(700.0, k * x)) for x, t in tokens.items())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    decay = max(low, 0.05)
    found = sum(s for x, (_, s) in tail.items() if x > 0) + 0.5
    return decay, min(1.0, found / n * math.exp(min(50.0, decay * lowest)))


def calibrate(rows: DataFrame, model: Model, weight: tuple[float, float]) -> tuple[list[float], list[float]]:
    """The share of toxic rows over ln(1 + evidence), made rising by pooling neighbours that are out of order (isotonic
    regression on bins). weight: what a clean and a toxic row of the sample stand for. One row of each kind at its own
    end is added, so the curve has both ends whatever the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bins = Weights(shared.value.by_feature), Counter()
        for batch in batches:
            for text, y in zip(batch["t"], batch["y"], strict=True):
                best, n, _ = _best(text, weights)
                bins[round(math.log1p(shared.value.evidence(best, n)), 1), int(y)] += 1
        yield pd.DataFrame([(x, y, c) for (x, y), c in bins.items()], columns=["x", "y", "n"])

    found = map_pandas(rows.select("t", "y"), run, "x double, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    bins: dict[float, list[float]] = {0.0: [weight[0], 0.0], 5.0: [0.0, weight[1]]}
    for r in found:
        bins.setdefault(r.x, [0.0, 0.0])[r.y] += r.n * weight[r.y]
    pooled: list[list[float]] = []  # sum of x by weight, toxic, all
    for x, (clean, toxic) in sorted(bins.items()):
        pooled.append([x * (clean + toxic), toxic, clean + toxic])
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last, strict=True)]
    return [x / n for x, _, n in pooled], [t / n for _, t, n in pooled]


def _best(text: str | None, weights: Weights) -> tuple[float, int, list[tuple[int, int, float]]]:
    tokens = text.split() if text else []
    found = segments([weights[w] for w in tokens])
    weights.trim()
    return max((x for _, _, x in found), default=0.0), len(tokens), found


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For each row: doc_id, the columns in keep, score, predicted and passages: the significant segments as word ranges
    (start, end) with their score and p-value.

    Null and empty texts have no passage and the probability of none; so has every text if the model knows no word.
    Repeated rows are scored each on its own; a very long text is taken whole, one at a time; no rows in: no rows out. Of
    other columns only those in keep are read; they must not be called doc_id, score, predicted or passages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    chosen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = Weights(m.by_feature)
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                probability, passages = [], []
                for text in part.column("_text").to_pylist():
                    best, n, found = _best(text, weights)
                    probability.append(m.probability(m.evidence(best, n)))
                    passages.append([{"start": a, "end": z, "score": x, "p": p} for a, z, x in found if (p := m.p_value(x, n)) <= SIGNIFICANT])
                new = [pa.array(probability, pa.float64()), pa.array([int(p >= THRESHOLD) for p in probability], pa.int32()), pa.array(passages, PASSAGES)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], "score", "predicted", "passages"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_arrow(chosen, run, f"{fields}, score double, predicted int, passages array<struct<start:long,end:long,score:double,p:double>>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns labels only from rows whose crc32(id) mod 4 is not 2."""
    return train(docs, labels.filter(crc_mod(F.col("doc_id"), 4) != 2))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: doc_id, held_out, score, predicted. Labels of a null id or null labels teach nothing, several of one id
    are toxic if any is, and copies of a text teach once; else as in score. Without labels every row has the low score."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
