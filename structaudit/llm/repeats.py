"""Repeated strings of a minimum length, by interval expansion on a Burrows-Wheeler transform.

Spark brings together what could be equal: every window of ``LENGTH`` bytes holds an anchor, the
``ANCHOR`` bytes with the smallest hash in it, and equal windows hold equal anchors at equal places.
Neighbouring windows with one anchor form a segment. Segments with equal content are merged and counted
first, so copies cost one row each time they are met; what is left for an anchor is indexed.

Within a block of segments the transform is expanded backwards, breadth first: an interval of
suffixes that begin with w gives the intervals of cw. A border between neighbouring suffixes
that is met first at level l has a common prefix of l bytes, so common prefixes appear by increasing value,
and the search stops at ``LENGTH``: borders not met by then lie inside a repeated string.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed, slices, text_rows

LENGTH, ANCHOR = 200, 32
WIDTH = LENGTH - ANCHOR + 1
SHIFT = 256  # above the windows of a segment, WIDTH at most
#: Bytes of text looked at together, and bytes of segments in one block.
TEXT_BYTES, BLOCK_BYTES = 1_500_000, 700_000
#: Anchors with more different segments than this are cut into single windows instead.
SEGMENTS = 6_000
BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of BASE, and of its inverse, modulo 2**64."""
    power, inverse = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    table = np.random.default_rng(15_485_863).integers(1, 1 << 63, 256, dtype=np.uint64)
    return table, np.cumprod(power), np.cumprod(inverse)


def _powers_for(n: int):
    return _powers(1 << max(21, int(n + 1).bit_length()))


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Segments of several texts in a row: (text, first window, last window, anchor hash).

    Windows that do not lie inside one text belong to none.
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    table, power, inverse = _powers_for(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * power[:n], out=sums[1:])
    value = (sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    low = 32  # a text has fewer bytes than this leaves room for; ties go to the leftmost place
    packed = (value >> np.uint64(low) << np.uint64(low)) | np.arange(len(value), dtype=np.uint64)
    padded = np.full(-(-len(packed) // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    rows = padded.reshape(-1, WIDTH)
    left = np.minimum.accumulate(rows, axis=1).reshape(-1)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    count = n - LENGTH + 1
    anchor = np.minimum(right[:count], left[WIDTH - 1 : WIDTH - 1 + count]) & np.uint64((1 << low) - 1)
    text = np.repeat(np.arange(len(starts)), ends - starts)[:count]
    whole = np.arange(count) + LENGTH <= ends[text]
    fresh = np.ones(count, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], count) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    return text[first], first, last, value[anchor[first].astype(np.int64)]


def anchors_of(docs: DataFrame) -> DataFrame:
    """(key, n): anchors, each with how many segments of texts looked at together it has."""

    def run(batches):
        for batch in batches:
            for parts, _, _ in _together(batch.column(0)):
                ends = np.cumsum([len(p) for p in parts])
                key = anchored(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)[3]
                value, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select(F.col("text").cast("binary")).where(F.octet_length("text") >= LENGTH).mapInArrow(run, "key bigint, n bigint")


def _together(texts: pa.Array):
    """Texts of about ``TEXT_BYTES`` together: (texts, first, end)."""
    for i, j in slices(pa.compute.binary_length(texts).to_pylist(), TEXT_BYTES):
        yield texts.slice(i, j - i).to_pylist(), i, j


def segments_of(docs: DataFrame) -> DataFrame:
    """(key, seg, t1, t2, at): a segment's anchor and content, its text, and SHIFT * first window + windows."""

    def run(batches):
        for batch in batches:
            t1, t2, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for parts, i, _ in _together(texts):
                raw = b"".join(parts)
                ends = np.cumsum([len(p) for p in parts])
                starts = ends - [len(p) for p in parts]
                text, first, last, key = anchored(np.frombuffer(raw, np.uint8), starts, ends)
                digest = xxhash.xxh3_64_intdigest
                seg = np.fromiter(
                    (digest(raw[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), seg.view(np.int64), t1[text + i], t2[text + i], (first - starts[text]) * SHIFT + last - first + 1)],
                    ["key", "seg", "t1", "t2", "at"],
                )

    return docs.select("t1", "t2", F.col("text").cast("binary")).where(F.octet_length("text") >= LENGTH).mapInArrow(
        run, "key bigint, seg bigint, t1 bigint, t2 bigint, at bigint"
    )


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in order of their first ``depth`` symbols at least, by doubling."""
    n = len(text)
    used = np.flatnonzero(np.bincount(text))
    small = np.zeros(int(used[-1]) + 1, np.uint64)
    small[used] = np.arange(len(used)) + (used[0] > 0)  # 0 stays 0
    bits, place = max(1, int(len(used)).bit_length()), max(1, int(n).bit_length())
    h = max(1, (64 - place) // bits)
    padded = np.zeros(n + h, np.uint64)
    padded[:n] = small[text]
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    while True:
        order, fresh = _sorted(key, place)
        if h >= depth or fresh.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        key = rank << np.uint64(place)
        key[: n - h] |= rank[h:]
        h *= 2


def _sorted(key: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where a new key begins. Sorting key and place as one number is the quicker way."""
    fresh = np.ones(len(key), bool)
    if int(key.max()).bit_length() + place <= 64:
        both = np.sort((key << np.uint64(place)) | np.arange(len(key), dtype=np.uint64))
        sorted_key, order = both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)
    else:
        order = np.argsort(key)
        sorted_key = key[order]
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    return order, fresh


def common_prefixes(bwt: np.ndarray, stop: int) -> np.ndarray:
    """Common prefix of each suffix with the one before, by interval expansion; -1 if ``stop`` or more.

    Symbol 0 parts the texts: it is never extended, so no prefix reaches over it. A border beside a
    suffix that ends before ``stop`` may stay at -1.
    """
    n = len(bwt)
    forward = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    by_symbol = np.argsort(bwt, kind="stable")
    forward[by_symbol] = np.arange(n)
    first_symbol = bwt[by_symbol]
    border = np.full(n + 1, -1, np.int32)
    border[0] = border[n] = 0
    low, high = np.array([0]), np.array([n])
    for level in range(stop):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(total)
        owner = np.repeat(np.arange(len(low)), size)
        inside = bwt[at] > 0
        to, owner = forward[at[inside]], owner[inside]
        if total * 8 > n:
            mark = np.full(n, -1, np.int64)
            mark[to] = owner
            to = np.flatnonzero(mark >= 0)
            owner = mark[to]
        else:
            order = np.argsort(to)
            to, owner = to[order], owner[order]
        if not len(to):
            break
        fresh = np.ones(len(to), bool)
        symbol = first_symbol[to]
        fresh[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        start = np.flatnonzero(fresh)
        low, high = to[start], to[np.append(start[1:], len(to)) - 1] + 1
        new = border[high] < 0
        low, high = low[new], high[new]
        border[high] = level
    return border[:n]


def repeated_windows(segments: list[bytes], copies: np.ndarray) -> list[np.ndarray]:
    """For each of the different ``segments``: which of its windows occur twice or more.

    A segment with several copies counts that many times.
    """
    length = np.array([len(s) for s in segments])
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    text = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint16) + 1
    text[ends - 1] = 0
    order = suffixes(text, LENGTH + 1)
    border = common_prefixes(text[order - 1], LENGTH)
    owner = np.repeat(np.arange(len(segments)), length + 1)[order]
    window = order + LENGTH <= (ends - 1)[owner]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (border[1:] >= 0) | ~window[1:] | ~window[:-1]
    group = np.cumsum(fresh) - 1
    often = (np.bincount(group, weights=copies[owner] * window) >= 2)[group] & window
    hit = np.zeros(len(text), bool)
    hit[order[often]] = True
    return [hit[s : s + n - LENGTH + 1] for s, n in zip(starts.tolist(), length.tolist(), strict=True)]


def runs_of(mask: np.ndarray) -> list[int]:
    """Starts and ends (exclusive) of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(t1, t2, found): for each text, by its two hashes, the window runs that occur elsewhere too."""
    occurrences = segments_of(docs)
    # Anchors met once go before anything else is kept; most of a text's do.
    keys = anchors_of(docs).groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    again = checkpointed(occurrences.join(keys, "key"))
    segments = again.groupBy("key", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("t1", "t2", "at")).alias("first"))
    wanted = checkpointed(segments.select("key", "seg", "copies", "first.*"))
    different = wanted.groupBy("key").agg(F.count("*").alias("different"))
    counted_keys = wanted.join(different, "key")
    # An anchor with one segment only has copies of it: once merged, nothing is left to set it against.
    alone = counted_keys.where("different = 1").select("key", "seg", F.array(F.lit(0).cast("bigint"), F.col("at") % SHIFT).alias("found"))
    several = counted_keys.where("different > 1")
    size = several.agg(F.sum(F.col("at") % SHIFT + LENGTH).alias("b")).first()["b"] or 0

    blocks = max(1, -(-size // BLOCK_BYTES))
    few = _bodies(docs, several.where(F.col("different") <= SEGMENTS))
    few = few.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    marked = few.groupBy("block").applyInArrow(_expanded, "key bigint, seg bigint, found array<bigint>")
    # Anchors in very many segments: their windows are counted one by one.
    many = _bodies(docs, several.where(F.col("different") > SEGMENTS)).dropDuplicates(["key", "seg"])
    single = many.mapInArrow(_single_windows, "key bigint, seg bigint, w bigint, copies bigint, h1 bigint, h2 bigint")
    often = single.groupBy("h1", "h2").agg(F.sum("copies").alias("total")).where("total > 1").select("h1", "h2")
    counted = single.join(often, ["h1", "h2"]).groupBy("key", "seg").agg(
        F.flatten(F.sort_array(F.collect_set(F.array("w", F.col("w") + 1)))).alias("found")
    )
    marks = marked.where(F.size("found") > 0).union(counted).union(alone)
    met = again.join(marks, ["key", "seg"])
    place = F.floor(F.col("at") / SHIFT).alias("lo")
    return met.select("t1", "t2", F.struct(place, "found").alias("m")).groupBy("t1", "t2").agg(F.collect_set("m").alias("found"))


def _bodies(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """The bytes of each segment, from one of the rows that hold its text; a few may come twice."""
    # The segments of one text overlap by less than a window's length, so the list is bounded by the text.
    by_text = segments.groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "key", "seg", "copies")).alias("cut"))
    # All columns of docs go along: the shuffle of the texts is then the one that the answers use as well.
    met = docs.join(by_text, ["t1", "t2"]).select("doc_id", "t1", "t2", "cut", F.col("text").cast("binary").alias("text"))
    return met.mapInArrow(_cutter, "key bigint, seg bigint, copies bigint, body binary")


def _cutter(batches):
    seen: set[tuple[int, int]] = set()  # copies follow each other; the list is only kept short
    for batch in batches:
        rows = []
        for t1, t2, cut, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            if (t1, t2) in seen:
                continue
            seen.add((t1, t2))
            for s in cut:
                lo, n = divmod(s["at"], SHIFT)
                rows.append((s["key"], s["seg"], s["copies"], text[lo : lo + n - 1 + LENGTH]))
        if len(seen) > 50_000:
            seen.clear()
        for i, j in slices([len(r[3]) for r in rows], TEXT_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows[i:j]], pa.int64()) for k in range(3)] + [pa.array([r[3] for r in rows[i:j]], pa.binary())],
                ["key", "seg", "copies", "body"],
            )


def _expanded(group: pa.Table) -> pa.Table:
    names = list(zip(group["key"].to_pylist(), group["seg"].to_pylist(), strict=True))
    group = group.take(pa.array(list(dict(zip(names[::-1], range(len(names))[::-1], strict=True)).values())))
    masks = repeated_windows(group["body"].to_pylist(), group["copies"].to_numpy())
    return pa.table({"key": group["key"], "seg": group["seg"], "found": pa.array([runs_of(m) for m in masks], pa.list_(pa.int64()))})


def _single_windows(batches):
    for batch in batches:
        keys, segs, copies, bodies = (batch.column(i).to_pylist() for i in range(4))
        for i, j in slices([len(b) for b in bodies], TEXT_BYTES // 16):
            rows = [(k, s, w, c, xxhash.xxh3_128_intdigest(b[w : w + LENGTH])) for k, s, c, b in zip(keys[i:j], segs[i:j], copies[i:j], bodies[i:j], strict=True) for w in range(len(b) - LENGTH + 1)]
            half = [np.array([r[4] >> k & (1 << 64) - 1 for r in rows], np.uint64).view(np.int64) for k in (0, 64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array(h) for h in half],
                ["key", "seg", "w", "copies", "h1", "h2"],
            )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    A byte goes if it is covered by a string of 200 bytes that also starts anywhere else in any
    document, the same one included; all is judged on the input. ``kept`` holds the remaining bytes.
    Each row is a document of its own, so repeated rows repeat each other. Null and empty texts, and all below
    200 bytes, lose nothing. A null doc_id is carried as null, extra columns are ignored, an empty table gives
    no rows. Equal texts share their answer, which is looked up by two hashes of 64 bits.
    """
    rows = text_rows(docs).withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")
    )
    met = rows.join(repeated_ranges(rows), ["t1", "t2"], "left")

    def run(batches):
        for batch in batches:
            out = []
            runs = batch.column(2).flatten()
            of_row = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(2)).fill_null(0).to_numpy())])
            edges_of_run = pa.compute.list_value_length(runs.field(1)).to_numpy()
            edges = runs.field(1).flatten().to_numpy() + np.repeat(runs.field(0).to_numpy(), edges_of_run)
            of_row = np.concatenate([[0], np.cumsum(edges_of_run)])[of_row]
            for text, first, end in zip(batch.column(1).to_pylist(), of_row[:-1].tolist(), of_row[1:].tolist(), strict=True):
                n = len(text)
                if first == end:
                    out.append((n, 0, 0, text))
                    continue
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, edges[first:end:2], 1)
                np.add.at(change, edges[first + 1 : end : 2] - 1 + LENGTH, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((n, n - len(kept), len(runs_of(gone)) // 2, kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
                + [pa.array([hashlib.sha256(r[3]).hexdigest() for r in out]), pa.array([r[3] for r in out], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return met.select("doc_id", F.col("text").cast("binary"), "found").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    )
