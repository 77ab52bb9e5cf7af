"""Token counts by offset-mapped attribution.

A document is encoded whole, once. Its tokens' spans are laid over the spans of its sections (interval join by binary
search), and a token that crosses a boundary goes to one section by an explicit rule:

- ``first``: the section that holds its first byte (the default);
- ``last``: the section that holds its last byte;
- ``most``: the section that holds most of its bytes, the earlier one in a tie.

So a document's sections always add up to its tokens. Spans are counted in UTF-8 bytes inside, which agree with
characters at every section boundary; a byte-level token may hold a part of a character only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._util import map_pandas

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "most")
_encoders: dict[tuple[str, str], tuple] = {}


def read_vocabulary(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file (one token a line, so bounded by the vocabulary), read on the driver; a path with a scheme is
    read by Spark."""
    if "://" in path:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    else:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def digest_of(ranks: dict[bytes, int]) -> str:
    """What tells one vocabulary from another."""
    h = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        h.update(b"%d:%d:%s;" % (rank, len(token), token))
    return h.hexdigest()


def encoder(ranks: dict[bytes, int], pattern: str, digest: str) -> tuple:
    """An encoding and the byte length of each of its tokens; a Python worker keeps the last one."""
    import tiktoken

    key = (digest, pattern)
    if key not in _encoders:
        _encoders.clear()
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[key]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens by section, and how many cross a boundary. ends: where each token ends; bounds: where each section ends,
    not falling; sections and tokens both cover the text without gaps."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    to = last if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for k in crossing.tolist():
            cuts = np.concatenate([[starts[k]], bounds[first[k] : last[k]], [ends[k]]])
            to[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=len(bounds))[: len(bounds)], len(crossing)


def section_bounds(parts: list[str], delimiter: str) -> np.ndarray:
    """Where each section of the joined parts ends, in bytes; a section keeps the delimiter that ends it."""
    sizes = []
    for k, part in enumerate(parts):
        pieces = part.split(delimiter) if delimiter else [part]
        tail = len(delimiter.encode())
        sizes += [len(p.encode("utf-8", "surrogatepass")) + tail for p in pieces[:-1]]
        sizes.append(len(pieces[-1].encode("utf-8", "surrogatepass")) + (k < len(parts) - 1) * 1)
    return np.cumsum(sizes)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), delimiter: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """For each row: doc_id, n_chars, n_tokens, n_crossing, section_tokens (tokens of each section in order).

    The fields are joined by one newline, which belongs to the field before it, and encoded as one text; sections are
    the pieces of the fields between delimiters (none: the fields themselves). The sum of section_tokens is n_tokens.

    Null fields are empty; an empty text is one section of no tokens. Control strings of the tokenizer are ordinary
    text. Repeated rows are counted each on their own; a very long text is encoded whole; no rows in: no rows out. Other
    columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ranks = read_vocabulary(spark, vocabulary)
    shared = spark.sparkContext.broadcast((ranks, pattern, digest_of(ranks)))
    chosen = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{k}") for k, f in enumerate(fields)])
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = encoder(*shared.value)
        for batch in batches:
            out = []
            for parts in zip(*[batch[f"f{k}"] for k in range(len(fields))], strict=True):
                text = "\n".join(parts)
                ends = np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())]) if text else np.zeros(0, np.int64)
                by, crossing = attribute(ends, section_bounds(list(parts), delimiter), rule)
                out.append((len(text), len(ends), crossing, by.astype(np.int32)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: pd.Series([r[k] for r in out], index=batch.index, dtype=t) for k, (c, t) in enumerate((("n_chars", "int64"), ("n_tokens", "int64"), ("n_crossing", "int64"), ("section_tokens", object)))}})

    return map_pandas(chosen, run, f"doc_id {kind}, n_chars long, n_tokens long, n_crossing long, section_tokens array<int>")
