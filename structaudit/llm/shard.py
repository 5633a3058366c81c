"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Row numbers 0 .. n-1 are permuted by a Feistel network over the pairs (left, right) of
``a x b >= n`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``. A value that lands at n or
above is permuted again until it is below n (cycle walking), which keeps the map a permutation
of 0 .. n-1. Shard and slot follow from the permuted number alone, so where a row goes can be
computed from (row number, n, seed) without looking at any other row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed, text_rows

ROUNDS, SEED = 6, 20_240_611
#: Below ``a`` numbers lie outside the range, so a walk ends after ``a`` steps at most: after 64
#: for n <= 4096. Above, 64 steps do not end with a chance of about n**-32; that is an error.
WALK = 64
M1, M2, P1, P2 = 1_103_515_245, 741_103_597, 2_147_483_647, 2_147_483_629


def round_keys(seed: int) -> list[int]:
    keys, x = [], seed % P1
    for _ in range(ROUNDS):
        x = (x * 48_271 + 11) % P1
        keys.append(x)
    return keys


def mixed(x: int, key: int) -> int:
    """Round function; each product stays below 2**62."""
    return ((((x % P1) + key) % P1) * M1 % P1 + 1) * M2 % P2


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(n - 1) + 1) if n else 1
    return a, max(1, -(-n // a))


def permute_once(x: int, n: int, seed: int) -> int:
    """One pass of the network for a plain number; the column form does the same."""
    a, b = sides(n)
    left, right = x // b, x % b
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = (right + mixed(left, key)) % b
        else:
            left = (left + mixed(right, key)) % a
    return left * b + right


def permute(x: int, n: int, seed: int) -> int:
    """Place of row ``x`` among ``n`` rows."""
    while (x := permute_once(x, n, seed)) >= n:
        pass
    return x


def row_at(shard: int, slot: int, n: int, seed: int, shards: int) -> int:
    """Row number that holds ``slot`` of ``shard``: the permutation run backwards."""
    a, b = sides(n)
    x = slot * shards + shard
    while True:
        left, right = x // b, x % b
        for i, key in reversed(list(enumerate(round_keys(seed)))):
            if i % 2:
                right = (right - mixed(left, key)) % b
            else:
                left = (left - mixed(right, key)) % a
        if (x := left * b + right) < n:
            return x


def permuted(number: str, n: int, seed: int) -> Column:
    """Column form of :func:`permute` for the bigint column ``number``, built-in functions only."""
    a, b = sides(n)

    def round_of(side: str, key: int) -> str:
        return f"(((({side} % {P1}L + {key}L) % {P1}L) * {M1}L % {P1}L + 1L) * {M2}L % {P2}L)"

    def network(v: str) -> str:
        left, right = f"({v} div {b}L)", f"({v} % {b}L)"
        for i, key in enumerate(round_keys(seed)):
            if i % 2:
                right = f"(({right} + {round_of(left, key)}) % {b}L)"
            else:
                left = f"(({left} + {round_of(right, key)}) % {a}L)"
        return f"({left} * {b}L + {right})"

    # Step 0 always permutes; later steps only while the value lies outside.
    walked = F.expr(
        f"aggregate(sequence(0, {WALK}), {number}, (v, i) -> if(i > 0 and v < {n}L, v, {network('v')}))"
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with a global row number in ``order``, and how many there are.

    Rows are range-partitioned and sorted, then written to the checkpoint folder, which fixes what
    lies where. Each row's number is its place in its part plus the rows of all earlier parts;
    the only thing gathered is one count per part.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]
    )
    fixed = checkpointed(ranged).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", 33)
    counts = {r["part"]: r["n"] for r in fixed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part bigint, _before bigint")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per part of the data: as small as Spark's own list of tasks.
    out = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(*rows.columns, (F.col("_before") + within).alias(name)), total


def feistel_shards(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """Shard and slot of every document; shard sizes in rows differ by one at most.

    Row numbers follow (doc_id, text_crc32, size), nulls first. Rows that agree in all three are
    interchangeable: together they get the same set of places however they are read. A null text
    counts as empty, an empty table gives no rows, and other columns are ignored.
    Returns doc_id, size, text_crc32, row_number, shard, slot.
    """
    text = F.coalesce("text", F.lit(""))
    rows = text_rows(docs).select(
        "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    with_number, n = numbered(rows, ["doc_id", "text_crc32", "size"], "row_number")
    place = permuted("row_number", max(n, 1), seed)
    out = with_number.select("*", place.alias("_to"))
    return out.select(
        "doc_id", "size", "text_crc32", "row_number", (F.col("_to") % shards).cast("int").alias("shard"),
        ((F.col("_to") - F.col("_to") % shards) / shards).cast("bigint").alias("slot"),
    )
