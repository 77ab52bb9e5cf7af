"""Text to unit vectors by feature hashing, behind the interface of a sentence model: a limit of tokens, a fixed dimension.

No model is installed here; tokens are hashed instead, so equal texts have equal vectors and shared words bring them
closer. What depends on a model (the tokens, a token's place and sign) stands in three functions."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.plans.cluster import ship

#: Words and single other characters; the model adds one token before and one after.
TOKEN = r"\w+|[^\w\s]"
SPECIAL_TOKENS = 2
#: Rows whose sums are held at a time: 6 MB.
PIECE_ROWS = 2_000


def tokens(text: Column) -> Column:
    """As they stand in the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """All tokens, the special ones too, whatever the limit."""
    return F.size(tokens(text)) + SPECIAL_TOKENS


@lru_cache(100_000)
def place(token: str) -> tuple[int, float]:
    """Which dimension a token adds to, and with which sign. ASCII counts in lower case, the rest as it is: Spark has lowered it."""
    h = md5((token.lower() if token.isascii() else token).encode()).hexdigest()
    return int(h[:8], 16) % C.EMBEDDING_DIM, 1.0 if int(h[8], 16) % 2 == 0 else -1.0


def _vectors(words: pa.Array) -> pa.Array:
    """A unit vector for each row of tokens. A piece of rows is added up at a time, by the places of its distinct tokens."""
    out = np.empty((len(words), C.EMBEDDING_DIM), np.float32)
    for start in range(0, len(words), PIECE_ROWS):
        piece = words.slice(start, PIECE_ROWS)
        size, flat = pc.list_value_length(piece).to_numpy(zero_copy_only=False), piece.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        at, sign = (np.array(x) for x in zip(*map(place, [*known, ""]), strict=True))
        bare = np.flatnonzero(size == 0)
        row = np.concatenate([np.repeat(np.arange(len(piece)), size), bare])
        code = np.concatenate([flat.indices.to_numpy(zero_copy_only=False), np.full(len(bare), len(known))])
        m = np.bincount(row * C.EMBEDDING_DIM + at[code], sign[code], len(piece) * C.EMBEDDING_DIM).reshape(-1, C.EMBEDDING_DIM)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        out[start : start + len(piece)] = m / np.where(norm > 0, norm, 1)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, C.EMBEDDING_DIM, dtype=np.int32)), pa.array(out.ravel()))


def _measures(vectors: pa.Array) -> pa.Array:
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, C.EMBEDDING_DIM)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
    return pa.StructArray.from_arrays([pa.array(x.astype(np.float64)) for x in (norm, m.sum(axis=1, dtype=np.float64), m.max(axis=1))], ["norm", "total", "most"])


def measures(embedding: Column) -> Column:
    """(norm, total, most) of vectors as embed makes them: length, sum and largest entry, in double. Where only these are asked
    for, Spark runs both functions in one pass and the vectors stay in the Python worker."""
    return F.arrow_udf(_measures, "norm double, total double, most double")(embedding)


def embed(df: DataFrame, text_col: str) -> DataFrame:
    """df with token_count and embedding: a float vector of length one over the tokens within the limit. A text without tokens,
    null too, has the vector of its special tokens alone. No rows: no rows."""
    ship(df.sparkSession)
    own = df.select("*", tokens(F.col(text_col)).alias("_all"))
    words = F.slice("_all", 1, C.MAX_MODEL_TOKENS - SPECIAL_TOKENS)
    # Python and Spark know different versions of Unicode
    words = F.when(F.octet_length(text_col) > F.length(text_col), F.transform(words, F.lower)).otherwise(words)
    vector = F.arrow_udf(_vectors, "array<float>")(words)
    return own.select(*df.columns, (F.size("_all") + SPECIAL_TOKENS).alias("token_count"), vector.alias("embedding"))
