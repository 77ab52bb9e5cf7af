"""Language-model scores by online logistic context mixing.

A text is a sequence of bytes and an end symbol, each written in the bits of a prefix code, Huffman's for the training
bytes after the byte before; so the model is a proper distribution over texts. For each bit, predictors look up how often
it was 0 and 1 in training after their own hashed context: the last 3 and 5 bytes, and the word begun so far. Their
log-odds are added up with weights from a set that a gate chooses (which contexts were ever seen, how deep the bit lies in
its code), and a map learnt with them refines the sum. While a text is read, two gains, of the short and of the long
contexts, follow it block by block.

Everything is gathered from all training texts: words and bytes by counting, contexts by adding up tables of a fixed
number of slots, range by range. Weights and map are learnt online on one in TUNE_MOD of the texts, whose contexts are not
yet in the tables and are added afterwards. What a task needs for scoring has a fixed size; words too rare for that are
counted by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _words
from lodestone.llm._util import crc_mod, discard, map_arrow, materialize

HELD_MOD, HELD_OUT = 7, 2
TUNE_MOD = 56
END = 256
#: Predictors: bytes of context (0: the word begun so far), each with a table of 2 ** BITS slots.
CONTEXTS, BITS = (3, 5, 0), 22
INPUTS, TABLE = len(CONTEXTS), 1 << BITS
SLOTS = INPUTS * TABLE
#: Slots are added up in so many ranges.
RANGES = 64
RANGE = -(-SLOTS // RANGES)
#: Log-odds are kept as bytes, so many steps to one; 0 is a slot that was never seen.
STEPS = 15.0
#: A text is read in segments of so many symbols side by side; each begins with the learnt weights and the bytes before it.
SEGMENT = 1024
#: Gains follow a text after every so many bits.
BLOCK = 64
#: Bytes of text taken at once, and lanes read side by side.
PART, LANES = 1_500_000, 4_096
#: How fast gains follow a text, and how fast the weights are learnt.
RATE, LEARN = 0.003, 0.1
#: Gates: which of the long contexts, from LONG on, were seen, and the depth of the bit in its code. The map has bins for each.
LONG, DEPTHS, REACH, BINS = 1, 4, 8.0, 33
GATES = DEPTHS << (INPUTS - LONG)
#: Words that make up one of so many training tokens go out to every task; there are at most so many.
FREQUENT = 1 << 20
K1, K2 = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
SYMBOLS = END + 1
#: What bit a step is that only fills a block.
FILL = 2


class Code:
    """For each byte before (END: none) Huffman's prefix code of the bytes and the end, each counted once more than it occurs
    (counts: before * SYMBOLS + symbol). A step is a bit of a code word; the last one fills blocks."""

    def __init__(self, counts: dict[int, int]):
        length, node, bit, depth = [], [], [], []
        for before in range(SYMBOLS):
            paths = huffman([counts.get(before * SYMBOLS + s, 0) + 1 for s in range(SYMBOLS)])
            for path in paths:
                length.append(len(path))
                for d, (n, b) in enumerate(path):
                    node.append(n)
                    bit.append(b)
                    depth.append(min(d, DEPTHS - 1))
        self.length = np.array(length, np.int32)
        self.start = np.cumsum(self.length) - self.length
        spread = _words.mix((np.arange(2 * SYMBOLS).astype(np.uint64) + np.uint64(1)) * np.uint64(K1))
        self.node = (spread[np.array([*node, 0])] >> np.uint64(64 - BITS)).astype(np.uint32)
        self.bit = np.array([*bit, FILL], np.uint8)
        self.depth = np.array([*depth, 0], np.uint8)

    def steps(self, pair: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The steps of symbols one after the other; many: how many each has (fewer than there is room for: to be filled)."""
        total = int(many.sum())
        kind = np.int32 if total < 1 << 30 else np.int64
        at = (np.cumsum(many, dtype=np.int64) - many).astype(kind)
        out = np.repeat(self.start[pair].astype(kind) - at, many)
        out += np.arange(total, dtype=kind)
        return out

    def slots(self, base: np.ndarray, many: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The slot of each step, given the hashed context of each symbol and the node of each step."""
        out = np.repeat(base, many)
        out ^= node
        return out


def huffman(weights: list[int]) -> list[list[tuple[int, int]]]:
    """The path of each symbol from the root: (node, bit). Nodes are numbered from the root, 0."""
    heap = [(w, s) for s, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    new = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]], parent[b[1]] = (new, 0), (new, 1)
        heapq.heappush(heap, (a[0] + b[0], new))
        new += 1
    paths: dict[int, list[tuple[int, int]]] = {new - 1: []}
    for s in range(new - 2, -1, -1):  # a node's parent has a higher number
        up, bit = parent[s]
        paths[s] = [*paths[up], (new - 1 - up, bit)]
    return [paths[s] for s in range(len(weights))]


class Text:
    """Some texts as symbols one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        ends = offsets[1:] + np.arange(texts)
        symbol = np.full(len(data) + texts, END, np.int64)
        own = np.ones(len(symbol), bool)
        own[ends] = False
        symbol[own] = data
        sizes = np.diff(offsets) + 1
        self.of = np.repeat(np.arange(texts), sizes)
        self.inside = np.arange(len(symbol)) - np.repeat(ends + 1 - sizes, sizes)
        self.symbol = symbol
        before = np.roll(symbol, 1)
        before[self.inside == 0] = END
        self.pair = before * SYMBOLS + symbol
        # the bytes before each symbol, the last one lowest: read eight at a time, those of another text masked out
        longest = max(CONTEXTS)
        raw = np.concatenate([np.zeros(8, np.uint8), symbol.astype(np.uint8)])
        past = np.ndarray(len(symbol), ">u8", raw, 0, (1,)).astype(np.uint64)
        past &= ((np.uint64(1) << np.arange(longest + 1, dtype=np.uint64) * np.uint64(8)) - np.uint64(1))[np.minimum(self.inside, longest)]
        self.past = past

    def word(self) -> np.ndarray:
        """A hash of the word begun so far, from after the last separator on."""
        symbol, n = self.symbol, len(self.symbol)
        low = np.where((symbol >= 65) & (symbol <= 90), symbol + 32, symbol)
        within = np.append(~_words.NOT_ALNUM, False)[low]
        begins = self.inside == 0
        begins[1:] |= ~within[:-1]
        first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low + 1).view(np.uint64) * _words._power("up", _words.BASE, n), out=total[1:])
        return np.where(begins, self.past & np.uint64(255), (total[:n] - total[first]) * _words._power("down", _words.INVERSE, n)[first])

    def base(self, k: int) -> np.ndarray:
        """The hashed context of each symbol in the k-th table."""
        return based(self.past & window(k) if CONTEXTS[k] else self.word(), k)


def window(k: int) -> np.uint64:
    """The bytes of the k-th context among those before."""
    return np.uint64((1 << 8 * CONTEXTS[k]) - 1)


def based(context: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_words.mix(context + np.uint64(CONTEXTS[k] + 1) * K2) >> np.uint64(64 - BITS)).astype(np.uint32)


@dataclass
class Model:
    """What a task needs to score texts; of a fixed size."""

    code: Code
    odds: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int8))
    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 0.4, np.float32))
    refined: np.ndarray = field(default_factory=lambda: np.tile(squash(np.linspace(-REACH, REACH, BINS)), GATES).astype(np.float32))
    frequent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Lanes:
    """Segments of texts as blocks of bits, the longest first: bits, log-odds of each predictor and gates of all blocks, a byte
    each; the first block, number of blocks and text of each lane."""

    bit: np.ndarray
    odds: list[np.ndarray]
    gate: np.ndarray
    first: np.ndarray
    size: np.ndarray
    text: np.ndarray


def lanes(model: Model, text: Text) -> Lanes:
    code = model.code
    many = code.length[text.pair].astype(np.int64)
    begin = np.flatnonzero(text.inside % SEGMENT == 0)
    bits = np.add.reduceat(many, begin) if len(begin) else many
    # the last symbol of a segment is filled up to a whole block
    fill = -bits % BLOCK
    many[np.append(begin[1:], len(many))[: len(begin)] - 1] += fill
    step = code.steps(text.pair, many)
    filled = np.repeat(np.cumsum(bits + fill) - np.cumsum(fill), fill) + np.arange(int(fill.sum()))
    step[filled] = len(code.bit) - 1
    node, odds, gate = code.node[step], [], code.depth[step]
    for k in range(INPUTS):
        found = model.odds[k * TABLE : (k + 1) * TABLE][code.slots(text.base(k), many, node)]
        found[filled] = 0
        if k >= LONG:
            gate += (found != 0).view(np.uint8) * np.uint8(DEPTHS << (k - LONG))
        odds.append(found)
    size = (bits + fill) // BLOCK
    order = np.argsort(-size, kind="stable")
    return Lanes(code.bit[step], odds, gate, (np.cumsum(size) - size)[order], size[order], text.of[begin][order])


def read(model: Model, l: Lanes) -> np.ndarray:
    """The natural logarithm of the probability of each lane's bits. Each lane's gains begin at one and follow its own bits."""
    parts = []
    for own in (range(LONG), range(LONG, INPUTS)):
        part = np.zeros(len(l.bit), np.float32)
        for k in own:
            part += (model.weights[:, k] / np.float32(STEPS))[l.gate] * l.odds[k]
        parts.append(part.reshape(-1, BLOCK))
    out = np.zeros(len(l.first))
    for k in range(0, len(l.first), LANES):
        lane = slice(k, k + LANES)
        out[lane] = _follow(model, *parts, l.bit.reshape(-1, BLOCK), l.gate.reshape(-1, BLOCK), l.first[lane], l.size[lane])
    return out


def _follow(model: Model, short: np.ndarray, long: np.ndarray, bit: np.ndarray, gate: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    f = np.float32
    out, gains = np.zeros(len(first)), np.ones((2, len(first)), f)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="left")
    for t, (w, after) in enumerate(zip(alive, alive[1:])):
        at = first[:w] + t
        a, b, y = short[at], long[at], bit[at]
        mixed = a * gains[0, :w, None]
        mixed += b * gains[1, :w, None]
        p = np.exp(-mixed)
        p += 1
        np.reciprocal(p, out=p)
        miss = y - p
        spot = spots(mixed, gate[at])
        p += model.refined[spot]
        p *= f(0.5)
        np.clip(p, f(1e-5), f(1 - 1e-5), out=p)
        # the probability of what the bit is
        p *= y.astype(np.int8) * 2 - f(1)
        p += 1 - y
        if after < w:  # what only fills the last blocks
            fill = y[after:] == FILL
            p[after:][fill], miss[after:][fill] = 1, 0
        np.log(p, out=p)
        out[:w] += p.sum(axis=1, dtype=np.float64)
        gains[0, :w] += np.einsum("ij,ij->i", miss, a) * f(RATE)
        gains[1, :w] += np.einsum("ij,ij->i", miss, b) * f(RATE)
    return out


def spots(mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The bin of the map for each sum and gate."""
    x = np.clip(mixed, -REACH, REACH)
    x += REACH
    x *= (BINS - 1) / 2 / REACH
    x += 0.5
    return x.astype(np.int16) + gate * np.int16(BINS)


class Learner:
    """One set of weights learnt by all lanes together, bit after bit; what it gives is their mean over the way."""

    def __init__(self, model: Model):
        self.weights = model.weights.astype(np.float64)
        self.total, self.used = np.zeros((GATES, INPUTS)), np.zeros(GATES)
        self.seen = np.zeros((2, GATES * BINS))  # of the map's bins: bits, ones

    def read(self, l: Lanes) -> None:
        for t in range(int(l.size[0]) * BLOCK if len(l.size) else 0):
            at = l.first[: np.searchsorted(-l.size, -(t // BLOCK), side="left")] * BLOCK + t
            at = at[l.bit[at] != FILL]
            x, g, y = np.stack([o[at] for o in l.odds], axis=1) / STEPS, l.gate[at].astype(np.int64), l.bit[at]
            mixed = np.einsum("ij,ij->i", self.weights[g], x)
            miss = y - squash(mixed)
            n = np.bincount(g, minlength=GATES)
            for i in range(INPUTS):
                self.weights[:, i] += LEARN * np.bincount(g, weights=miss * x[:, i], minlength=GATES) / (n + 20)
            self.used += n
            self.total += self.weights * n[:, None]
            spot = spots(mixed, l.gate[at])
            self.seen[0] += np.bincount(spot, minlength=GATES * BINS)
            self.seen[1] += np.bincount(spot, weights=y, minlength=GATES * BINS)


def log_probability(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The natural logarithm of each text's probability."""
    l = lanes(model, Text(data, offsets))
    return np.bincount(l.text, weights=read(model, l), minlength=len(offsets) - 1)


# Gathering ---------------------------------------------------------------------------------------------------------------

COUNTS = "part int, size int, data binary"


#: A pair of symbols has so many bits set at most.
PAIR = (1 << 17) - 1


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs, or the sums of n."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys)) if n is None else np.add.reduceat(n, first)


class Tally:
    """How often each slot's bit was 0 and 1 in a task's texts."""

    def __init__(self):
        self.tables = [np.zeros(2 * TABLE, np.int32) for _ in CONTEXTS]

    def add(self, code: Code, text: Text) -> None:
        """Equal symbols after equal contexts are counted first, and only then taken apart into bits. A shorter context's
        counts are sums of the longest one's."""
        longest = CONTEXTS.index(max(CONTEXTS))
        found, n = summed((text.past & window(longest)) << np.uint64(17) | text.pair.view(np.uint64))
        for k, order in enumerate(CONTEXTS):
            if k == longest:
                self.put(code, k, based(found >> np.uint64(17), k), found, n)
            elif order:
                own, many = summed(found & (window(k) << np.uint64(17) | np.uint64(PAIR)), n)
                self.put(code, k, based(own >> np.uint64(17), k), own, many)
            else:
                own, many = summed(text.base(k).astype(np.uint64) << np.uint64(17) | text.pair.view(np.uint64))
                self.put(code, k, (own >> np.uint64(17)).astype(np.uint32), own, many)

    def put(self, code: Code, k: int, base: np.ndarray, found: np.ndarray, n: np.ndarray) -> None:
        pair = (found & np.uint64(PAIR)).astype(np.int64)
        many = code.length[pair].astype(np.int64)
        step = code.steps(pair, many)
        slot = code.slots(base, many, code.node[step]).astype(np.int64) * 2 + code.bit[step]
        np.add.at(self.tables[k], slot, np.repeat(n.astype(np.int32), many))

    def rows(self) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, t in enumerate(self.tables):
            t = t.reshape(-1, 2)
            own = np.flatnonzero(t.any(axis=1))
            place = own + k * TABLE
            ranges = range(k * TABLE // RANGE, ((k + 1) * TABLE - 1) // RANGE + 1)
            for r, a, z in zip(ranges, np.searchsorted(place, [r * RANGE for r in ranges]), np.searchsorted(place, [(r + 1) * RANGE for r in ranges]), strict=True):
                if z > a:
                    held.setdefault(r, []).append((place[a:z] - r * RANGE, t[own[a:z]]))
        for r, found in held.items():
            yield packed(r, np.concatenate([a for a, _ in found]), np.concatenate([n for _, n in found]))


def packed(part: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The slots of a range that were seen, as gaps and counts."""
    raw = np.concatenate([np.diff(at, prepend=0), n[:, 0], n[:, 1]]).astype(np.int64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], names=["part", "size", "data"])


def unpacked(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, 24 * size, codec="zstd", asbytes=True), np.int64).reshape(3, size)
    return np.cumsum(raw[0]), raw[1:].T


def added(parts: DataFrame) -> DataFrame:
    """Sums by range: a task holds its own ranges only, however many tasks counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, size, data in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "data")), strict=True):
                at, n = unpacked(size, data)
                held.setdefault(part, np.zeros((RANGE, 2), np.int64))[at] += n
        for part, n in held.items():
            own = np.flatnonzero(n.any(axis=1))
            yield packed(part, own, n[own])

    return map_arrow(parts.repartitionById(RANGES, "part"), run, COUNTS)


def odds_of(counts: DataFrame) -> np.ndarray:
    """The tables of log-odds, SLOTS bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, size, data in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "data")), strict=True):
                at, n = unpacked(size, data)
                x = np.clip(np.round(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)) * STEPS), -127, 127)
                out = np.zeros(RANGE, np.int8)
                out[at] = np.where(x == 0, 1, x)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "odds"])

    odds = np.zeros(RANGES * RANGE, np.int8)
    for r in map_arrow(counts, run, "part int, odds binary").toLocalIterator():
        odds[r.part * RANGE : (r.part + 1) * RANGE] = np.frombuffer(r.odds, np.int8)
    return odds[:SLOTS]


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in _words.slices(batch, "text", PART):
        yield part, *_words.utf8(part.column("text"))


def counted(training: DataFrame) -> DataFrame:
    """(word, key, n): how often each hashed word occurs, and each byte or end after each byte or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in texts_of(batch):
                low, starts, ends, _ = _words.words(data, offsets, _words.SPACE)
                h, n = np.unique(_words.hashes(low, starts, ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), bool)), pa.array(h.view(np.int64)), pa.array(n)], names=["word", "key", "n"])
                n = pairs_of(data, offsets)
                pairs = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs), bool)), pa.array(pairs), pa.array(n[pairs])], names=["word", "key", "n"])

    return map_arrow(training.select("text"), run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def pairs_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each symbol follows each, as Text.pair has them."""
    n = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    wide = data.astype(np.int64)
    n += np.bincount(wide[:-1] * SYMBOLS + wide[1:], minlength=len(n))
    first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
    inner = first[first > 0]
    np.add.at(n, wide[inner - 1] * SYMBOLS + wide[inner], -1)  # over the border of two texts
    np.add.at(n, END * SYMBOLS + wide[first], 1)
    np.add.at(n, wide[last] * SYMBOLS + END, 1)
    n[END * SYMBOLS + END] += len(offsets) - 1 - len(first)
    return n


def tallied(texts: DataFrame, code: Code) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = None
        for batch in batches:
            for _, data, offsets in texts_of(batch):
                tally = tally or Tally()
                tally.add(code, Text(data, offsets))
        if tally:
            yield from tally.rows()

    return map_arrow(texts.select("text"), run, COUNTS)


def learnt(spark: SparkSession, texts: DataFrame, model: Model) -> None:
    """Sets the weights and the map, the mean over tasks by how much each read. texts are not in the tables."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(sent.value)
        for batch in batches:
            for _, data, offsets in texts_of(batch):
                learner.read(lanes(sent.value, Text(data, offsets)))
        key = np.arange(GATES * INPUTS + learner.seen.shape[1])
        n = np.concatenate([np.repeat(learner.used, INPUTS), learner.seen[0]])
        x = np.concatenate([learner.total.ravel(), learner.seen[1]])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(x)], names=["key", "n", "x"])

    for r in map_arrow(texts.select("text"), run, "key long, n double, x double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        if r.key < GATES * INPUTS:
            if r.n:
                model.weights[r.key // INPUTS, r.key % INPUTS] = r.x / r.n
        else:
            at = r.key - GATES * INPUTS
            model.refined[at] = (r.x + 8 * model.refined[at]) / (r.n + 8)
    sent.unpersist()


def train(docs: DataFrame, vocabulary: DataFrame) -> Model:
    """docs: text, held_out, tune. vocabulary: as counted gives it."""
    spark = docs.sparkSession
    model = Model(Code({r.key: r.n for r in vocabulary.filter("not word").collect()}))
    main = materialize(added(tallied(docs.filter("not held_out and not tune"), model.code)), "score-counts")
    model.odds = odds_of(main)
    tune = docs.filter("not held_out and tune")
    learnt(spark, tune, model)
    model.odds = odds_of(added(main.unionByName(tallied(tune, model.code))))
    discard(main)
    return model


# Scoring -----------------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Learns from rows whose crc32(id as text) mod HELD_MOD is not HELD_OUT (a null id: the empty text). Tokens are words
    between white space, A-Z lower-cased, and one end; base_score is their add-one log10 probability, words told apart by
    64-bit hashes. score is the log10 probability of the text's bytes and its end; bits_per_byte counts the end as a byte.

    Null texts are empty ones and have their end. Repeated rows are scored and counted each on its own. Without training
    rows no word is known and every context is new. A very long text is one row of one task. No rows: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (crc_mod(F.col(id_col), HELD_MOD) == HELD_OUT).alias("held_out"))
    own = own.withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(TUNE_MOD)) == 0)
    vocabulary = materialize(counted(own.filter("not held_out")), "score-words")
    total = vocabulary.agg(F.coalesce(F.sum(F.when(F.col("word") | (F.col("key") % SYMBOLS == END), F.col("n"))), F.lit(0)).alias("n"), F.count_if(F.col("word")).alias("words"), F.coalesce(F.sum(F.when(~F.col("word") & (F.col("key") % SYMBOLS == END), F.col("n"))), F.lit(0)).alias("ends")).first()
    words = vocabulary.filter("word").select(F.col("key").alias("h"), "n")
    model = train(own, vocabulary)
    often = words.filter(F.col("n") * FREQUENT >= total.n).orderBy("h").toArrow()  # at most FREQUENT rows
    order = np.argsort(often.column("h").to_numpy().view(np.uint64))
    model.frequent, model.counts = often.column("h").to_numpy().view(np.uint64)[order], often.column("n").to_numpy()[order]
    sent, ends = spark.sparkContext.broadcast(model), int(total.ends)
    own = own.withColumn("key", F.xxhash64("doc_id", "text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def looked_up(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and text of each word, its place among the frequent ones, and whether it is there."""
        m = sent.value
        low, starts, stops, before = _words.words(data, offsets, _words.SPACE)
        h = _words.hashes(low, starts, stops)
        at = np.minimum(np.searchsorted(m.frequent, h), max(0, len(m.frequent) - 1))
        there = m.frequent[at] == h if len(m.frequent) else np.zeros(len(h), bool)
        return h, np.repeat(np.arange(len(offsets) - 1), np.diff(before)), at, there

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in texts_of(batch):
                h, text, _, there = looked_up(data, offsets)
                h, text = h[~there], text[~there]
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                first = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(text) != 0))[: len(h)])
                # and a row for each text, with no words
                rows = pa.array(np.append(text[first], np.arange(part.num_rows)))
                k = np.append(np.diff(first, append=len(h)), np.zeros(part.num_rows, np.int64)).astype(np.int32)
                key = part.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("key").take(rows), pa.array(np.append(h[first].view(np.int64), key)), pa.array(k)], names=["doc_id", "key", "h", "k"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part, data, offsets in texts_of(batch):
                n = part.num_rows
                h, text, at, there = looked_up(data, offsets)
                base = np.bincount(text[there], weights=np.log10(m.counts[at[there]] + 1.0), minlength=n) + np.log10(ends + 1.0)
                known = np.bincount(text[there], minlength=n) + (ends > 0)
                tokens = np.bincount(text, minlength=n) + 1
                ln = log_probability(m, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), part.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(ln / np.log(10)), pa.array(-ln / np.log(2) / (np.diff(offsets) + 1))],
                    names=["doc_id", "key", "held_out", "n_tokens", "known", "base", "score", "bits_per_byte"])

    cold = map_arrow(own.select("doc_id", "key", "text"), rare, f"doc_id {kind}, key long, h long, k int")
    cold = cold.join(words, "h", "left").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.count_if(F.col("k") == 0).alias("copies"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("rare_base"))
    scored = map_arrow(own, judge, f"doc_id {kind}, key long, held_out boolean, n_tokens long, known long, base double, score double, bits_per_byte double")
    out = scored.join(cold, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    each = float(np.log10(total.n + total.words + (total.ends > 0) + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.expr("rare_known div copies")).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base") / F.col("copies") - F.col("n_tokens") * each).alias("base_score"), "score", "bits_per_byte")
