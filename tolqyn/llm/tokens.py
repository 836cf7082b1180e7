"""Sizes of texts in tokens of a public tokenizer, and a place of each text on a space-filling curve."""

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The vocabulary (ranks of a byte-level BPE); a parameter of everything that counts tokens.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMS, LEVELS = 3, 12  # dimensions of the curve, and bits of each


@functools.lru_cache(4)
def encoding(ranks: str = RANKS):
    """Once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def hilbert_key(points: np.ndarray, bits: int = LEVELS) -> np.ndarray:
    """Distance along the Hilbert curve of points (n x dims of integers below 2**bits), by Skilling's transposition."""
    x = points.astype("i8").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            x[0] = np.where(hit, x[0] ^ p, x[0])
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measured(df: DataFrame, text: str = "text", ranks: str = RANKS, curve: bool = False) -> DataFrame:
    """The other columns of df with tokens int (0 for a null or empty text) and, with `curve`, hkey bigint.

    For the curve the bag of token ids is hashed into 256 buckets, made a unit vector, projected to DIMS random directions and
    scaled to the grid; texts alike in their words come near each other on the curve."""
    kept = [c for c in df.columns if c not in (text, "tokens", "hkey")]

    def run(batches):
        enc = encoding(ranks)
        rng = np.random.default_rng(17)
        bucket = rng.integers(0, 256, 200_000)
        project = rng.standard_normal((256, DIMS))
        project -= project.mean(axis=0)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            sizes, places = np.zeros(len(texts), "i4"), np.zeros((len(texts), DIMS))
            for lo in range(0, len(texts), 256):
                for i, ids in enumerate(enc.encode_ordinary_batch(texts[lo : lo + 256], num_threads=1)):
                    sizes[lo + i] = len(ids)
                    if curve and ids:
                        v = np.bincount(bucket[ids], minlength=256)
                        places[lo + i] = v @ project / np.sqrt(v @ v)
            cols = [batch.column(c) for c in kept] + [pa.array(sizes)]
            if curve:
                grid = np.clip((places / 6 + 0.5) * (1 << LEVELS), 0, (1 << LEVELS) - 1).astype("i8")
                cols.append(pa.array(hilbert_key(grid)))
            yield pa.RecordBatch.from_arrays(cols, [*kept, "tokens"] + ["hkey"] * curve)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
    return df.select(*kept, text).mapInArrow(run, ", ".join([*fields, "tokens int", *["hkey bigint"] * curve]))
