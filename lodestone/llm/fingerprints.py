"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds the modular prefix sums of a text's code points under two moduli. Any two spans, of one text or two,
are compared in constant time, and the longest common extension of two places is found by binary search.

A fingerprint is the length, the hash of the whole text, and the hashes of prefixes and suffixes at the multiples of
a step, the least power of two that gives ``GRID`` of them at most. Two fingerprints are compared at the multiples of
the larger step: binary search finds how far their beginnings and their ends agree, and the likeness is the share of
the longer text that this covers (1 for equal texts, less than 1 for any others up to hash collisions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._util import map_pandas, ordered_runs

#: Two primes under 2**31 and a base for each; products of two residues fit in 63 bits.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_181_783_497)
INVERSES = tuple(pow(b, -1, m) for b, m in zip(BASES, MODULI, strict=True))
GRID = 32
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "begin_edited", "end_edited", "begin_next", "end_next"]
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.int64)
        while len(have) < max(n, 4096):  # doubling: the second half is the first times a power
            have = np.concatenate([have, have * pow(base, len(have), modulus) % modulus])
        _tables[base] = have
    return have[:n]


class Prefix:
    """Prefix sums of c[i] * base**i under both moduli. Sums of residues stay under 2**63 for 2**32 code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.n = len(points)
        self.sums = []
        for base, modulus in zip(BASES, MODULI, strict=True):
            s = np.zeros(self.n + 1, np.int64)
            np.cumsum(points * _powers(base, modulus, self.n) % modulus, out=s[1:])
            self.sums.append(s % modulus)

    def span(self, start, size) -> list:
        """The hash of each span (arrays or numbers), equal for equal spans wherever they stand."""
        out = []
        for s, inverse, modulus in zip(self.sums, INVERSES, MODULI, strict=True):
            out.append((s[start + size] - s[start]) % modulus * _powers(inverse, modulus, self.n + 1)[start] % modulus)
        return out

    def whole(self) -> str:
        a, b = self.span(0, self.n)
        return f"{int(a):08x}{int(b):08x}"


def equal_spans(x: Prefix, i: int, y: Prefix, j: int, size: int) -> bool:
    return i + size <= x.n and j + size <= y.n and x.span(i, size) == y.span(j, size)


def extension(x: Prefix, i: int, y: Prefix, j: int, *, backward: bool = False) -> int:
    """How many code points agree from x[i], y[j] on, or before them, by binary search."""
    low, high = 0, min(i, j) if backward else min(x.n - i, y.n - j)
    while low < high:
        size = (low + high + 1) // 2
        same = equal_spans(x, i - size, y, j - size, size) if backward else equal_spans(x, i, y, j, size)
        low, high = (size, high) if same else (low, size - 1)
    return low


def step_of(n: int) -> int:
    return 1 << max(0, (n - 1) // GRID).bit_length() if n else 1


def fingerprint(p: Prefix) -> str:
    """Hexadecimal: length, hash of all, and 32-bit hashes of the prefixes and the suffixes of k * step code points."""
    sizes = np.arange(1, p.n // step_of(p.n) + 1) * step_of(p.n)
    first, last = p.span(np.zeros_like(sizes), sizes)[0], p.span(p.n - sizes, sizes)[0]
    return ":".join([f"{p.n:x}", p.whole(), first.astype(">u4").tobytes().hex(), last.astype(">u4").tobytes().hex()])


def likeness(a: str, b: str) -> float:
    """The share of the longer text that the common beginning and end cover, as far as the fingerprints tell."""
    if a == b:
        return 1.0
    (n, _, first, last), (m, _, first_b, last_b) = a.split(":"), b.split(":")
    n, m = int(n, 16), int(m, 16)
    step = max(step_of(n), step_of(m))
    most = min(n, m) // step

    def agree(x: str, y: str) -> int:
        low, high = 0, most
        while low < high:
            k = (low + high + 1) // 2
            i, j = (k * step // step_of(n) - 1) * 8, (k * step // step_of(m) - 1) * 8
            low, high = (k, high) if x[i : i + 8] == y[j : j + 8] else (low, k - 1)
        return low * step

    covered = min(agree(first, first_b) + agree(last, last_b), n, m)
    return min(covered, max(n, m) - 1) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per document; then
    begin_edited, end_edited, begin_next, end_next: how many code points the text has in common with its edited text and
    with the next document from the beginning on and up to the end, by binary search over the prefix hashes.

    The next document is the one with the next higher id, the first after the last. Documents go by ranges of the id, so
    that all but the ends of each range have their neighbour beside them; the next range's first comes along.

    Null texts are empty; a null id is the lowest; ids that are no integers go by their text; rows with one id follow each
    other by their texts. A single document is its own next one. A very long text is taken whole. No rows in: no rows
    out. Other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    own = own.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    dealt = ordered_runs(own, "key", F.octet_length("text"))
    dealt = dealt.filter("_role >= 0").sortWithinPartitions("_role", "key", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the document that waits for the next one
        first = None
        done = False
        for batch in batches:
            out = []
            for doc_id, text, role in zip(batch["doc_id"], batch["text"], batch["_role"], strict=True):
                if done:
                    break
                p = Prefix(text)
                now = (doc_id, text, p, fingerprint(p))
                if held:
                    out.append(_row(held, now))
                if role == 1:
                    held, done = None, True
                else:
                    held, first = now, first or now
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        if held:  # nothing follows: the only range, whose first comes after its last
            yield pd.DataFrame([_row(held, first)], columns=COLUMNS)

    return map_pandas(dealt.select("doc_id", "text", "_role"), run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, begin_edited long, end_edited long, begin_next long, end_next long")


def _row(held: tuple, following: tuple) -> tuple:
    doc_id, text, p, own = held
    other = edited(text, following[1])
    changed = Prefix(other)
    print_ = fingerprint(changed)
    shared = [x for y in (changed, following[2]) for x in (extension(p, 0, y, 0), extension(p, p.n, y, y.n, backward=True))]
    return doc_id, p.n, hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, following[3]), *shared
