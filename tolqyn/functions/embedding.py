"""A deterministic embedder that stands in for a neural one: feature hashing of words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolqyn.operators.quality import tokens


def hashed(df: DataFrame, text: str, dim: int = 64, terms: int = 1 << 16) -> DataFrame:
    """df with dense (unit vector of signed word hashes; null for a text without words), sparse_indices and sparse_values (share of each hashed
    word, ascending indices). The words are hashed in the JVM; a batch is turned into vectors at once."""
    kept = [c for c in df.columns if c not in ("dense", "sparse_indices", "sparse_values")]
    rows = df.select(*kept, F.transform(tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)).alias("_h"))

    def run(batches):
        for batch in batches:
            col = batch.column("_h")
            flat, n = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(n)), n)
            dense = np.zeros((len(n), dim))
            np.add.at(dense, (owner, (flat & 0x7FFFFFFF) % dim), np.where(flat < 0, -1.0, 1.0))
            norm = np.linalg.norm(dense, axis=1)
            dense /= np.where(norm > 0, norm, 1)[:, None]
            pair, count = np.unique(owner * np.int64(terms) + ((flat >> 16) & (terms - 1)), return_counts=True)
            who = pair // terms
            ends = np.searchsorted(who, np.arange(len(n) + 1)).astype("i4")
            share = (count / np.maximum(n, 1)[who]).astype("f4")
            vectors = pa.array([v if ok else None for v, ok in zip(dense.astype("f4"), norm > 0)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), vectors, pa.ListArray.from_arrays(ends, pa.array((pair % terms).astype("i4"))), pa.ListArray.from_arrays(ends, pa.array(share))],
                [*kept, "dense", "sparse_indices", "sparse_values"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return rows.mapInArrow(run, f"{fields}, dense array<float>, sparse_indices array<int>, sparse_values array<float>")
