"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits. Table v (v = 1 .. 2**(radius+1) - 1)
looks at the positions whose vector has an odd product with v. Up to ``radius`` differing positions
span too small a space to touch every v, so two fingerprints within the radius agree on all the
positions that some table looks at: no pair is missed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed, text_rows
from structaudit.llm.components import components

BITS = 64
SEED = 42
#: Buckets with more fingerprints are cut again by a second covering of the positions they leave open.
BUCKET = 4096
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half of the shingle hashes; zero without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    count, n = np.zeros(BITS, np.int64), len(parts) - words + 1
    for at in range(0, n, CHUNK):
        runs = [parts[at + i : at + i + min(CHUNK, n - at)] for i in range(words)]
        shingles = runs[0] if words == 1 else map(b" ".join, zip(*runs, strict=False))
        hashes = np.fromiter(map(digest, shingles), np.uint64, len(runs[0]))
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; a null text is an empty one."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            values = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def masks(radius: int, positions: list[int]) -> list[int]:
    """One mask for each table of the covering over ``positions``."""
    size = (1 << (radius + 1)) - 1
    vector = {p: i % size + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is connected by steps of at most ``radius`` bits."""
    left, edges = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            here, front = front[:256], front[256:]
            near = np.bitwise_count(here[:, None] ^ left[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                edges += zip(here[near[:, hit].argmax(axis=0)].view(np.int64).tolist(), left[hit].view(np.int64).tolist(), strict=True)
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return edges


def close_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) within the radius that keep all connections of the distinct fingerprints ``fp``."""
    first = masks(radius, list(range(BITS)))
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(first)]
    keyed = fps.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.*")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"])

    inner = None
    for t, m in enumerate(first):
        rest = masks(radius, [p for p in range(BITS) if not m >> p & 1])
        made = F.array(*[
            F.struct(F.lit(t2 + 1).alias("t2"), F.col("fp").bitwiseAND(F.lit(_signed(m2))).alias("key2"))
            for t2, m2 in enumerate(rest)
        ])
        inner = F.when(F.col("t") == t, made) if inner is None else inner.when(F.col("t") == t, made)
    whole = F.array(F.struct(F.lit(0).alias("t2"), F.lit(0).cast("bigint").alias("key2")))
    split = F.when(F.col("n") <= BUCKET, whole).otherwise(inner)
    # A bucket holds 4,096 fingerprints at most, or agrees on all but about 15 bits.
    buckets = (
        met.select("t", "key", "fp", F.explode(split).alias("y")).groupBy("t", "key", "y.t2", "y.key2")
        .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    )

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            found = [e for i in range(len(column)) for e in forest(values[at[i] : at[i + 1]].copy(), radius)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, ASCII letters in lower case. Documents link when their
    fingerprints differ in ``radius`` bits at most; the component is the smallest doc_id reachable.
    Null and empty texts have fingerprint zero and link like any other; repeated rows are answered
    one by one; a null doc_id never names a component (null if it has no other member); extra
    columns are ignored; an empty table gives no rows. Equal fingerprints are merged before
    any bucket is formed, so copies of a text cost one row however many there are.
    """
    fps = checkpointed(fingerprints(docs, words))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_edges(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = roots.join(distinct, "fp")
    least = named.groupBy("component").agg(F.min("least").alias("joint"))
    joint = named.select("fp", "component").join(least, "component").select("fp", "joint")
    labels = distinct.join(joint, "fp", "left").select("fp", F.coalesce("joint", "least").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")
