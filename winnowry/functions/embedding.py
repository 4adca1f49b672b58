"""Default text embedder: hashed character pairs, unit length. A caller may pass any other."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .pieces import arrow_type, by_pieces

DIMENSIONS = 64


def hash_embed(text: str, dimensions: int = DIMENSIONS):
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    counts = np.bincount((codes[:-1] * 31 + codes[1:]) % dimensions, minlength=dimensions).astype(float)
    length = np.sqrt((counts * counts).sum())
    return counts / length if length else counts


def embed_text(c: Column, dimensions: int = DIMENSIONS) -> Column:
    vectors = arrow_type("array<float>")

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        one = lambda t: t if t is None else hash_embed(t, dimensions).astype(np.float32)
        return by_pieces(texts, lambda some: [one(t) for t in some.to_pylist()], vectors)

    return embed(c)
