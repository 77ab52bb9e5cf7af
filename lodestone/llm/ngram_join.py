"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles. Two documents link when their sets' Jaccard similarity is at least
``SIMILARITY`` percent. Then their symmetric difference is at most a seventh of the sum of their sizes.

1. Documents with one and the same set form a class; all that follows is about classes.
2. Each shingle's hash falls into a chunk, by its high bits, and a chunk's parity code is the exclusive or of the hashes in
   it. Chunk widths depend on the size band (a power of four; a class in the upper quarter of its band also takes the next
   band's widths, so any two sizes within 4/3 share a band). Every differing shingle spoils one chunk at most. So of all
   codes in one order, the first ``d + 1`` of each of two linked classes have one in common, where d is the most
   shingles they can differ by: what stands before the first code they share is spoiled, on either side. This is exact
   for sets of every size; the number of codes grows with the set.
3. The order is any, as long as it is the same for all: codes whose shingles many documents of a sample repeat come last,
   then it goes by place. What the sample misses costs time, never a link. A class (in practice none) whose chunks are
   too few is compared to all others by its sketch (``against_all``).
4. Classes that share a chunk's code are compared by a bit sketch: bit (hash mod m) flips for each shingle. The Hamming
   distance of two sketches is never more than the symmetric difference, so pairs above the bound are dropped safely.
   Codes of up to ``FEW`` classes give their pairs at once and the distinct pairs then get their sketches; the classes of
   other codes meet in a bucket with their sketches.
5. What is left is verified on the shingle hashes themselves, re-read from the texts of the classes concerned.
6. A code that over ``HOT`` classes share belongs to classes most of whose text others repeat: large groups of near copies,
   or short texts around one passage. Its classes are first compared inside blocks together with two pivots of the code,
   and only as many pairs are verified as would join a block's components; large groups become one component there.
   Codes whose classes still are in several components are taken block against block, each pair of blocks a bucket of
   its own, and blocks of the code's largest component are not held against each other. First again only as many pairs
   are verified as would join components; then every plausible pair across components that is left. So no code's classes
   ever meet in one task, no group is expanded into all its pairs, and no link is given up.

Components come from alternating large-star and small-star rounds over the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _words
from lodestone.llm._util import discard, map_arrow, materialize, partitions

WORDS = 5
SIMILARITY = 75
FEW, HOT = 8, 64
BLOCK = 512
SKETCH_BITS = 2048
#: Shingles per chunk at the upper end of a band. A chunk holds one in the bands up to SMALL.
WIDE = 2.25
SMALL = 2
#: The sample that tells which shingles are common: so many rows, or this share of a large table; at most COMMON of them.
SAMPLE_ROWS = 20_000
SAMPLE_SHARE = 50
SAMPLE_TASK = 5_000
COMMON = 250_000
#: Edges in one file of a round's table, so that a small table does not cost a task for each shuffle partition.
EDGES = 200_000
SLICE_BYTES = 2_000_000
#: Classes a task remembers to have sent; forgetting one costs a repeated row, no more.
SEEN = 200_000
#: Size of the bit map by which the second reading skips texts of classes without a candidate.
MAP_BITS = 1 << 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Codes have 48 bits, which is less to shuffle. Two that agree by chance are a candidate that its sketch rules out.
CODE_SHIFT = np.uint64(16)


def shingle_sets(part: pa.RecordBatch, column: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; of a text with fewer words, one hash of all its words."""
    low, starts, ends, before = _words.words(*_words.utf8(part.column(column)), _words.SPACE)
    h = _words.hashes(low, starts, ends)

    def rolled(h: np.ndarray, size: int) -> np.ndarray:
        out = np.full(max(0, len(h) - size + 1), size, np.uint64)
        for k in range(size):
            out += _words.mix(h[k : k + len(out)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        return _words.mix(out)

    roll = rolled(h, words)
    for a, z in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if z - a >= words:
            s = np.sort(roll[a : z - words + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]
        else:
            yield rolled(h[a:z], z - a) if z > a else roll[:0]


def class_of(s: np.ndarray) -> int:
    """A 64-bit number that equal sets share."""
    return int(_words.mix(np.sum(_words.mix(s ^ GOLDEN), dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def band_of(n: int) -> int:
    """The power of four in n."""
    return (n.bit_length() - 1) // 2


def bands(n: int) -> list[tuple[int, int]]:
    """The bands a set of n takes part in, each with the most shingles it can differ by from a set it links to there."""
    own, larger = band_of(n), n * 100 // SIMILARITY
    above = 4 << 2 * own
    out = [(own, min(larger, above - 1))]
    if larger >= above:
        out.append((own + 1, larger))
    return [(band, (n + other) * (100 - SIMILARITY) // (100 + SIMILARITY)) for band, other in out]


def parity_keys(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, bool]:
    """The first codes of a set in each band it takes part in, one more than shingles can differ; and whether a band has too
    few. Chunks that hold only common shingles (sorted hashes) come last."""
    n, out, short = len(s), [], False
    usual = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
    for band, most in bands(n):
        if band <= SMALL:  # a chunk for each shingle
            chunk, code, last = np.zeros(n, np.uint64), _words.mix(s + np.uint64(band)), usual
        else:
            width = WIDE / (4 << 2 * band)
            chunk = (s.astype(np.float64) / 2.0**64 / width).astype(np.int64)
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            code = np.bitwise_xor.reduceat(_words.mix(s + np.uint64(band)), first)
            last = np.logical_and.reduceat(usual, first)
            chunk = chunk[first].astype(np.uint64)
        short |= len(code) <= most
        take = np.argsort(last, kind="stable")[: most + 1] if last.any() else slice(most + 1)
        out.append(_words.mix(code[take] + chunk[take] * GOLDEN + np.uint64(band)) >> CODE_SHIFT)
    return np.concatenate(out), short


def sketch(s: np.ndarray) -> bytes:
    """Bit h mod m is set if it was flipped an odd number of times; m is a power of two, four times as many as there are
    shingles or less, and SKETCH_BITS or more, so that few flips of small sets cancel."""
    m = max(SKETCH_BITS, 4 << (len(s).bit_length() - 1))
    bits = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of one length: the upper half of a longer one goes onto the lower, which is what a shorter m
    would have given."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size), np.uint8)
    for k, b in enumerate(sketches):
        x = np.frombuffer(b, np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out.view(np.uint64)


def plausible(n: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs can still link: by size, then by Hamming distance against floor((|A| + |B|) (100-p) / (100+p))."""
    a, b = n[i], n[j]
    ok = np.flatnonzero(100 * np.minimum(a, b) >= SIMILARITY * np.maximum(a, b))
    out = np.zeros(len(i), bool)
    for at in range(0, len(ok), 100_000):
        k = ok[at : at + 100_000]
        distance = np.bitwise_count(rows[i[k]] ^ rows[j[k]]).sum(axis=1, dtype=np.int64)
        out[k] = (100 + SIMILARITY) * distance <= (100 - SIMILARITY) * (a[k] + b[k])
    return out


def forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs of nodes in order, those that join what the earlier ones have not."""
    up = list(range(int(max(i.max(initial=0), j.max(initial=0))) + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[b] = a
            kept.append(k)
    return np.array(kept, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict[str, np.ndarray | list]]:
    """Consecutive rows with one value of a column, together; batches are sorted by it."""
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> Iterator[dict]:
        t = pa.Table.from_batches(parts)
        data = {c: t.column(c).to_pylist() if pa.types.is_binary(t.schema.field(c).type) or pa.types.is_large_binary(t.schema.field(c).type) else t.column(c).to_numpy() for c in t.column_names}
        g = data[column]
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, z in zip(cuts, cuts[1:]):
            yield {c: v[a:z] for c, v in data.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(column).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(g, g[-1])) if (g[:-1] <= g[1:]).all() else int(np.flatnonzero(g != g[-1])[-1]) + 1
        if last or (held and held[-1].column(column)[-1].as_py() != g[-1]):
            held.append(batch.slice(0, last))
            yield from whole([b for b in held if b.num_rows])
            held = []
        held.append(batch.slice(last))
    if held := [b for b in held if b.num_rows]:
        yield from whole(held)


PAIRS = "a long, b long"


def _framed(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def bucket_pairs(rows: DataFrame, *, spanning: bool) -> DataFrame:
    """Plausible pairs (a < b) of classes of different components with one bucket. rows: bucket, cls, n, sketch, comp, side; a
    bucket is of bounded size. In a bucket of two sides only pairs across them are looked at. spanning: only as many pairs
    as join what all of them join, the least class first."""
    parts = partitions(rows.sparkSession)
    dealt = rows.select("bucket", "cls", "n", "sketch", "comp", "side").repartition(parts, "bucket").sortWithinPartitions("bucket", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in _groups(batches, "bucket"):
            cls, first = np.unique(g["cls"], return_index=True)
            if len(cls) < 2:
                continue
            i, j = np.triu_indices(len(cls), 1)
            comp, side = np.unique(g["comp"][first], return_inverse=True)[1], g["side"][first]
            apart = comp[i] != comp[j]
            if side.min() != side.max():
                apart &= side[i] != side[j]
            i, j = i[apart], j[apart]
            ok = plausible(g["n"][first], fold([g["sketch"][k] for k in first]), i, j)
            i, j = i[ok], j[ok]
            if spanning:
                kept = forest(comp[i], comp[j])
                i, j = i[kept], j[kept]
            a.append(cls[i])
            b.append(cls[j])
            if len(a) > 5000:
                yield _framed(a, b)
                a, b = [], []
        if a:
            yield _framed(a, b)

    return map_arrow(dealt, run, PAIRS)


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The plausible ones of pairs (a, b) of classes. marks: cls, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            sizes = np.stack([batch.column(c).to_numpy() for c in ("n", "m")], axis=1).ravel()
            width = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)], np.int64)
            keep = np.zeros(len(x), bool)
            for w in np.unique(width).tolist():  # a power of two for each size of set
                own = np.flatnonzero(width == w)
                rows = fold([v for k in own.tolist() for v in (x[k], y[k])])
                i = np.arange(0, len(rows), 2)
                keep[own] = plausible(sizes.reshape(-1, 2)[own].ravel(), rows, i, i + 1)
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(keep)))

    j = pairs.join(marks.select(F.col("cls").alias("a"), "n", F.col("sketch").alias("x")), "a")
    j = j.join(marks.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    return map_arrow(j.select("a", "b", "n", "m", "x", "y"), run, PAIRS)


def sets_of(texts: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, data): the shingle hashes of the classes wanted (cls), by a second reading of the texts. A bit map of fixed size
    says whose to take; what it lets through besides falls out of the join."""
    spark = wanted.sparkSession
    slot = F.pmod(F.col("cls"), F.lit(MAP_BITS))
    marks = wanted.select((slot / 64).cast("int").alias("w"), (slot % 64).cast("int").alias("i"))
    marks = marks.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits")).collect()  # at most MAP_BITS / 64 rows
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[[r.w for r in marks]] = [r.bits for r in marks]
    shared = spark.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = shared.value, set()
        for batch in batches:
            for part in _words.slices(batch, "text", SLICE_BYTES):
                cls, data = [], []
                for s in shingle_sets(part, "text", words):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    at = c % MAP_BITS
                    if marked[at // 64] >> np.int64(at % 64) & 1:
                        if len(seen) < SEEN:
                            seen.add(c)
                        cls.append(c)
                        data.append(s.tobytes())
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(data, pa.binary())], names=["cls", "data"])

    # copies of a set in several tasks: one is enough
    sets = map_arrow(texts.select("text"), read, "cls long, data binary")
    return materialize(sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("data").alias("data")), "join-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that do link, by their sets (cls, data)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(a) + len(b) - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    j = pairs.join(sets.select(F.col("cls").alias("a"), F.col("data").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("data").alias("y")), "b")
    return map_arrow(j.select("a", "b", "x", "y"), check, PAIRS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of the edges (a, b) is joined to. Rounds of large-star and small-star, each
    written down; a hub's neighbours are never gathered, only their least."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    state, parts = None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small, old = small.filter("u <> v").distinct(), e
        e = materialize(small.coalesce(parts) if parts else small, "stars")
        discard(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.written = e.written
            return out
        state, parts = now, 1 + now.n // EDGES


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample repeat, COMMON at most; only the order of codes hangs on them.
    A task tells of shingles that two of its documents hold, so what it sends is small."""
    n = docs.count()
    share = max(SAMPLE_ROWS, n // SAMPLE_SHARE) / max(n, 1)
    rows = docs if share >= 1 else docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1_000_000_007)) < int(share * 1_000_000_007))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in _words.slices(batch, "text", SLICE_BYTES):
                for s in shingle_sets(part, "text", words):
                    held.append(s)
                    size += len(s)
                if size > 4_000_000:
                    yield repeated(held)
                    held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        s, many = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s[many > 1].view(np.int64)), pa.array(many[many > 1])], names=["s", "many"])

    rows = rows.select("text").coalesce(max(1, round(min(1, share) * n) // SAMPLE_TASK))
    found = map_arrow(rows, run, "s long, many long").groupBy("s").agg(F.sum("many").alias("many")).filter("many > 4")
    return np.sort(found.orderBy(F.desc("many"), "s").limit(COMMON).select("s").toArrow().column("s").to_numpy().view(np.uint64))


def prepared(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, cls for each document; keys, sketch and short beside the first document of a class in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in _words.slices(batch, "text", SLICE_BYTES):
                n, cls, keys, sketches, short = [], [], [], [], []
                for s in shingle_sets(part, "text", words):
                    n.append(len(s))
                    c = class_of(s) if len(s) else None
                    cls.append(c)
                    new = c is not None and c not in seen
                    codes, few = parity_keys(s, shared.value) if new else (None, None)
                    keys.append(codes.view(np.int64) if new else None)
                    sketches.append(sketch(s) if new else None)
                    short.append(few)
                    if new:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(c)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(short, pa.bool_())],
                    names=["doc_id", "n", "cls", "keys", "sketch", "short"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, n long, cls long, keys array<long>, sketch binary, short boolean")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id that links lead to.

    Null and blank texts have no shingles and link with nothing, not even each other. Rows with one id are documents of
    their own; a null id counts as no id when the least is taken, unless a component has no other. Very long texts are
    taken whole, one at a time. No rows in: no rows out. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = materialize(prepared(own, words), "join-codes")
    rows = materialize(coded.select("doc_id", "n", "cls"), "join-rows")
    # one row per class; copies were dropped inside each task already
    classes = materialize(coded.filter("keys is not null").groupBy("cls", "n").agg(F.first("sketch").alias("sketch"), F.first("short").alias("short")), "join-classes")
    # a code that stands once tells nothing; copies of a class from several tasks are one
    keyed = coded.filter("keys is not null").select("cls", F.explode("keys").alias("key"))
    several = materialize(keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1").select("key"), "join-several")
    shared = materialize(keyed.join(several, "key").distinct(), "join-shared")
    discard(coded, several)
    roots = roots_of(own, classes, shared, words)
    discard(classes, shared)
    least = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named, "join-named")
    name = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(name, "root").select("cls", "component_id")
    out = rows.select("doc_id", "n", "cls").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def roots_of(texts: DataFrame, classes: DataFrame, shared: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, root) of all classes (cls, n, sketch, short) that are linked: the components of all links. shared: (key, cls) of
    the codes that several classes have."""
    counts = shared.groupBy("key").agg(F.count("*").alias("many"))
    counted = materialize(shared.join(counts.filter("many > 1"), "key"), "join-counted")
    few = counted.filter(F.col("many") <= FEW)
    some = counted.filter((F.col("many") > FEW) & (F.col("many") <= HOT)).select(F.col("key").alias("bucket"), "cls")
    hot = counted.filter(F.col("many") > HOT).select("key", "cls")
    marks = classes.select("cls", "n", "sketch")
    near = few.select("key", F.col("cls").alias("a")).join(few.select("key", F.col("cls").alias("b")), "key").filter("a < b").select("a", "b")
    near = materialize(near.distinct(), "join-near")
    pairs = bucket_pairs(some.join(marks, "cls").select("*", F.col("cls").alias("comp"), F.lit(0).alias("side")), spanning=False)
    pairs = materialize(likely(near, marks).unionByName(pairs).unionByName(against_all(classes)).distinct(), "join-pairs")
    discard(near)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(hot.select("cls")).distinct()
    sets = sets_of(texts, wanted, words)
    roots = components(verified(pairs, sets))
    discard(pairs)
    for step in (inside_blocks, across_blocks, lambda member: across_blocks(member, spanning=False)):
        member = mixed_members(hot, roots, marks)
        more = None if member.isEmpty() else materialize(step(member).distinct(), "join-pairs")
        if more is not None:
            # what was found stands as stars, which further rounds only join
            old, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(more, sets)))
            discard(old, more)
        discard(member)
        if more is None:
            break
    discard(counted, sets)
    return roots


def mixed_members(hot: DataFrame, roots: DataFrame, marks: DataFrame) -> DataFrame:
    """The classes of each hot code whose classes are in several components: key, cls, n, sketch, comp; many, and rest: how many
    are in the code's largest component or not; main: that component; p, q: its least and greatest class."""
    member = hot.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    size = member.groupBy("key", "comp").agg(F.count("*").alias("k"), F.min("cls").alias("p"), F.max("cls").alias("q"))
    main = F.max(F.struct("k", "comp"))
    per = size.groupBy("key").agg(F.sum("k").alias("many"), main["comp"].alias("main"), (F.sum("k") - main["k"]).alias("rest"), F.min("p").alias("p"), F.max("q").alias("q"))
    return materialize(member.join(per.filter("rest > 0"), "key").join(marks, "cls"), "join-members")


def inside_blocks(member: DataFrame) -> DataFrame:
    """Pairs that would join the components inside each block of each hot code; the code's least and greatest class are
    in every block."""
    blocks = F.ceil(F.col("many") / HOT)
    own = member.withColumn("block", F.pmod(F.xxhash64("cls"), blocks))
    pivot = member.filter("cls = p or cls = q").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return bucket_pairs(own.unionByName(pivot).withColumn("bucket", F.xxhash64("key", "block")).withColumn("side", F.lit(0)), spanning=True)


def across_blocks(member: DataFrame, *, spanning: bool = True) -> DataFrame:
    """Plausible pairs across components of each hot code, a bucket for each two of its blocks. The largest component has
    blocks of its own, which meet only the others'."""
    few, many = F.ceil(F.col("rest") / BLOCK), F.ceil((F.col("many") - F.col("rest")) / BLOCK)
    inside = F.col("comp") == F.col("main")
    at = F.pmod(F.xxhash64("cls"), F.when(inside, many).otherwise(few)) + F.when(inside, few).otherwise(F.lit(0))
    dealt = member.withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, few).otherwise(few + many) - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return bucket_pairs(dealt.withColumn("bucket", F.xxhash64("key", low, high)).withColumn("side", (F.col("block") > F.col("other")).cast("int")), spanning=spanning)


def against_all(classes: DataFrame) -> DataFrame:
    """Plausible pairs of each class marked short with all classes: a query set, in blocks of at most BLOCK. Of random hashes
    about one in 10**9 sets falls into too few chunks."""
    spark = classes.sparkSession
    short = classes.filter("short").select("cls", "n", "sketch")
    out = spark.createDataFrame([], PAIRS)
    many = short.count()
    for b in range(-(-many // BLOCK)):
        block = short.filter(F.pmod(F.xxhash64("cls"), F.lit(-(-many // BLOCK))) == b).collect()
        if block:
            out = out.unionByName(_against(classes, [tuple(r) for r in block]))
    return out


def _against(classes: DataFrame, block: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, n, sketches = map(list, zip(*[(c, m, bytes(x)) for c, m, x in block], strict=True))
        for batch in batches:
            a, b = [], []
            for c, m, x in zip(batch.column("cls").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                near = [k for k, size in enumerate(n) if 100 * min(size, m) >= SIMILARITY * max(size, m) and cls[k] != c]
                if near:
                    rows, sizes = fold([x, *[sketches[k] for k in near]]), np.array([m, *[n[k] for k in near]])
                    i = np.arange(1, len(rows))
                    hit = plausible(sizes, rows, np.zeros_like(i), i)
                    other = np.array([cls[k] for k in near], np.int64)[hit]
                    a.append(np.minimum(other, c))
                    b.append(np.maximum(other, c))
            if a:
                yield _framed(a, b)

    return map_arrow(classes.select("cls", "n", "sketch"), run, PAIRS)
