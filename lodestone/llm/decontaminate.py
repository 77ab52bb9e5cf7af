"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents with about ``SHARD_BYTES`` of text. Its alphabet is the benchmark's vocabulary: a word
outside it ends a run, since no phrase spans it, and runs shorter than the shortest phrase are left out. Over the rest
stands an FM-index: Burrows-Wheeler transform as a wavelet matrix of packed bits, ranks by counting bits, suffix
positions kept for every ``SAMPLE``-th place. All test phrases are searched backward at once; occurrences are located by walking to the next
sampled position, and their word spans are merged. Shards are independent: nothing is shuffled, and a lost executor
costs its shards only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _words
from lodestone.llm._util import map_arrow, materialize

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 2_000_000
#: Benchmark text held at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 8_000_000
#: A document counts as contaminated from one hit word in so many words.
SHARE = 20
#: Words, as NOT_ALNUM parts them, for an expression.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A run of hit words: its first word and number of words, and the range of code points.
HITS = "array<struct<first:long,words:long,start:long,end:long>>"
HIT_TYPE = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "end")]))


class Bits:
    """A bit vector with constant-time ranks: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


class FMIndex:
    """Over symbols 0..sigma-1; 0 separates runs and occurs in no phrase. What is kept of a text of n symbols: the wavelet
    matrix, about 1.5 bits a symbol and level (which also gives back the transform), and every sample-th position."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.text_len = n = len(text) + 1  # a least symbol ends the text
        seq = np.concatenate([text + 1, [0]]).astype(np.int64)
        rank, step = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while step < n and rank.max() < n - 1:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            step *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        self.levels, self.zeros = [], []
        rest = seq[order - 1]
        for level in reversed(range(max(1, int(sigma).bit_length()))):
            bit = rest >> level & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.marked = Bits(order % sample == 0)
        self.kept = order[order % sample == 0].astype(np.int32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        low = np.zeros(len(at), np.int64)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = (symbol >> (len(self.levels) - 1 - k)) & 1 == 1
            one, one_low = bits.ones(at), bits.ones(low)
            at = np.where(bit, zeros + one, at - one)
            low = np.where(bit, zeros + one_low, low - one_low)
        return at - low

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier: the symbol is read off the levels on the way."""
        symbol, at, low = np.zeros(len(rows), np.int64), rows, np.zeros(len(rows), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit, one, one_low = bits.get(at), bits.ones(at), bits.ones(low)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + one, at - one)
            low = np.where(bit, zeros + one_low, low - one_low)
        return self.first[symbol] + at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases of one length (rows of symbols): the range of rows of each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.text_len)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k] + 1
            low[live] = self.first[symbol] + self.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the nearest sampled one."""
        out, live, steps = np.full(len(rows), -1), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            here = rows[live]
            done = self.marked.get(here)
            out[live[done]] = self.kept[self.marked.ones(here[done])] + steps
            live = live[~done]
            rows[live] = self.back(here[~done])
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, over the block's own vocabulary: for each length the distinct windows as rows
    of symbols, and whose they are as a run of item numbers for each window. All are flat arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        number = np.searchsorted(np.array(self.ids, object), np.array([i for i, _ in items], object)) if items else np.zeros(0, np.int64)
        data, offsets = _words.utf8(pa.array([t for _, t in items], pa.string()))
        low, starts, ends, before = _words.words(data, offsets, _words.NOT_ALNUM)
        h = _words.hashes(low, starts, ends)
        self.vocabulary, symbol = np.unique(h, return_inverse=True)
        symbol = symbol.astype(np.int32)
        many = np.diff(before)
        of = np.repeat(np.arange(len(items)), many)
        size = np.minimum(window, many)[of]
        begins = np.arange(len(h)) - before[of] + size <= many[of]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size).tolist():
            at = np.flatnonzero(begins & (size == n))
            _, first, same = np.unique(_words.hashes_of_runs(h, at, n), return_index=True, return_inverse=True)
            pairs = np.unique(same * len(self.ids) + number[of[at]])
            owners, runs = pairs % len(self.ids), np.searchsorted(pairs // len(self.ids), np.arange(len(first) + 1))
            self.by_length[n] = (symbol[at[first][:, None] + np.arange(n)] + 1, owners, runs)
        self.shortest = min(self.by_length, default=0)

    def occurrences(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In the words of a shard (hashes; words before each document): start and length of each occurrence, and the
        items it belongs to as two arrays, occurrence and item."""
        none = np.zeros(0, np.int64)
        if not self.by_length or not len(h):
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        # runs of known words inside one document
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        edge = before[before < len(h)]
        begins[edge] |= known[edge]
        starts = np.flatnonzero(begins)
        stops = known.copy()
        stops[:-1] &= ~known[1:] | begins[1:]
        ends = np.flatnonzero(stops) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return none, none, none, none
        sizes = ends - starts + 1  # with a separator after each run
        base = np.cumsum(sizes) - sizes
        place = np.repeat(starts - base, sizes) + np.arange(sizes.sum())  # of each symbol, among the words
        last = base + sizes - 1
        text = at[np.minimum(place, len(h) - 1)] + 1
        text[last] = 0
        index = FMIndex(text, len(self.vocabulary) + 1)
        where, length, occ, item = [], [], [], []
        for n, (phrases, owners, runs) in self.by_length.items():
            low, high = index.search(phrases)
            many = high - low
            hit = np.flatnonzero(many)
            if not len(hit):
                continue
            many = many[hit]
            rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            seen = sum(map(len, where))
            where.append(place[index.locate(rows)])
            length.append(np.full(len(rows), n))
            phrase = np.repeat(hit, many)
            owned = runs[phrase + 1] - runs[phrase]
            occ.append(np.repeat(np.arange(len(rows)), owned) + seen)
            item.append(owners[np.repeat(runs[phrase] - np.cumsum(owned) + owned, owned) + np.arange(int(owned.sum()))])
        if not where:
            return none, none, none, none
        return tuple(map(np.concatenate, (where, length, occ, item)))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc_id, the columns in keep, n_words, n_hit, items (item_ids as text, sorted), spans and contaminated.

    Words are runs of ASCII letters (lower-cased), digits and all characters beyond ASCII. A phrase is a window of
    consecutive words of an item, or the whole of a shorter item. spans are the merged occurrences as code point ranges
    (start, end), from the first letter of the first word to the last of the last. contaminated: a word is hit, and one
    word in SHARE at least.

    Null and empty texts have no words, hence no hits; items without words have no phrases; items that share an id
    count as one; a null item_id is the empty text. Repeated documents are judged each on its own; a very long one is a
    shard by itself. No documents: no rows; no items: no hits. Of other columns only those in keep are read; they must not bear the names above.
    """
    spark = docs.sparkSession
    keep = keep or []
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    chosen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    count = int(size) // BLOCK_BYTES + 1
    if count == 1:
        found, _ = found_in(chosen, items, window, ["doc_id", *keep], kept, every=True)
        return found.select("doc_id", *keep, "n_words", *judged(F.col("n_words"), F.col("hits"), F.col("items")))
    # a larger benchmark: one block after the other goes out, is searched for in rows that were numbered and written once, and
    # is taken back
    chosen = materialize(chosen.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = []
    for b in range(count):
        block = items.filter(F.pmod(F.xxhash64("i"), F.lit(count)) == b)
        hits, sent = found_in(chosen.select("_row", "_text"), block, window, ["_row"], "_row long", every=False)
        found.append(materialize(hits, "decontaminate-block"))
        sent.destroy()
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    both = merged(both.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    n_words = F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(WORD)).cast("long")
    out = chosen.withColumn("n_words", n_words).drop("_text").join(both, "_row", "left")
    hits, own = F.coalesce("hits", F.array().cast(HITS)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", *keep, "n_words", *judged(F.col("n_words"), hits, own))


def judged(n_words: Column, hits: Column, items: Column) -> list[Column]:
    """n_hit, items, spans and contaminated, from merged hits."""
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda s, x: s + x["words"])
    spans = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return [n_hit.alias("n_hit"), items.alias("items"), spans.alias("spans"), ((n_hit > 0) & (SHARE * n_hit >= n_words)).alias("contaminated")]


_phrases: dict[str, Phrases] = {}


def phrases_of(token: str, items: list[tuple[str, str | None]], window: int) -> Phrases:
    """The phrases of a block; a Python worker keeps those of one block only."""
    if token not in _phrases:
        _phrases.clear()
        _phrases[token] = Phrases(items, window)
    return _phrases[token]


def found_in(docs: DataFrame, items: DataFrame, window: int, carried: list[str], kinds: str, *, every: bool) -> tuple[DataFrame, Broadcast]:
    """The carried columns, n_words, hits (merged) and items of each row of docs, or of those with a hit, for one block of items.
    The block's texts go out, at most about BLOCK_BYTES; workers make phrases of them. Beside it what went out, to be taken back."""
    block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.i, r.t) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of(*block.value, window)
        for batch in batches:
            for part in _words.slices(batch, "_text", SHARD_BYTES):
                out = _shard(part, phrases, carried)
                yield out if every else out.filter(pa.array([bool(x) for x in out.column("hits").to_pylist()], pa.bool_()))

    return map_arrow(docs.select(*carried, "_text"), run, f"{kinds}, n_words long, hits {HITS}, items array<string>"), block


def merged(rows: DataFrame) -> DataFrame:
    """(_row, hits, items) with hits that overlap or follow each other without a gap as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column("hits").to_pylist():
                own: list[dict] = []
                for h in sorted(hits, key=lambda h: h["first"]):
                    last = own[-1] if own else None
                    if last and h["first"] <= last["first"] + last["words"]:
                        last["words"] = max(last["words"], h["first"] + h["words"] - last["first"])
                        last["end"] = max(last["end"], h["end"])
                    else:
                        own.append(dict(h))
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, HIT_TYPE), batch.column("items")], names=["_row", "hits", "items"])

    return map_arrow(rows.select("_row", "hits", "items"), run, f"_row long, hits {HITS}, items array<string>")


def _shard(part: pa.RecordBatch, phrases: Phrases, carried: list[str]) -> pa.RecordBatch:
    data, offsets = _words.utf8(part.column("_text"))
    low, starts, ends, before = _words.words(data, offsets, _words.NOT_ALNUM)
    edges = np.zeros(len(starts) + 1, np.int64)
    items: dict[int, set[str]] = {}
    where, length, occ, item = phrases.occurrences(_words.hashes(low, starts, ends), before)
    np.add.at(edges, where, 1)
    np.add.at(edges, where + length, -1)
    doc = np.searchsorted(before, where[occ], side="right") - 1
    for pair in np.unique(doc * max(1, len(phrases.ids)) + item):
        items.setdefault(int(pair) // len(phrases.ids), set()).add(phrases.ids[int(pair) % len(phrases.ids)])
    hit = np.cumsum(edges)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_words, n_hit = np.diff(before), total[before[1:]] - total[before[:-1]]
    hits: list[list[dict]] = [[] for _ in range(len(n_words))]
    for k in np.flatnonzero(n_hit):
        # occurrences that follow each other without a gap are one hit
        own = np.concatenate([[False], hit[before[k] : before[k + 1]], [False]])
        a, z = np.flatnonzero(own[1:] & ~own[:-1]), np.flatnonzero(own[:-1] & ~own[1:]) - 1
        chars = np.concatenate([[0], np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)])
        x, y = chars[starts[before[k] + a] - offsets[k]], chars[ends[before[k] + z] - offsets[k]]
        hits[k] = [{"first": int(f), "words": int(g - f + 1), "start": int(c), "end": int(d)} for f, g, c, d in zip(a, z, x, y, strict=True)]
    columns = [part.column(c) for c in carried]
    columns += [pa.array(n_words), pa.array(hits, HIT_TYPE), pa.array([sorted(items.get(k, ())) for k in range(len(n_words))], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[*carried, "n_words", "hits", "items"])


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its code point ranges, which are merged and in order."""
    at, out = 0, []
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, benchmark)
    return s.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
