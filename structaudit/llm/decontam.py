"""Benchmark decontamination: rare n-gram seeds join documents to test items, Smith-Waterman alignment decides.

Items are cut into pieces of at most PIECE words. A seed is a pair of words one or two apart in the piece, and
it hits where the pair stands one or two apart in a document: one word between them may be replaced, added or left out.
An alignment of at least half the best score has, in a piece of L words, L/2 - 1 neighbouring matches with one edit
at most between them, each beginning at a place of its own. So the commonest places of a piece (by counts
over all documents) need no seeds, and a passage must still be hit at some of the others: rarity saves work
and loses no copy, whatever the counts are.

Documents are read three times: to count the pairs that items hold, for the passages that seeds hit, and for the words of
those passages that a piece shares enough seeds with. What is broadcast is a bitmap of BITS bits however many items
or passages there are; it only saves shuffling, as the joins by equal values decide.
Equal passages are aligned once, and so are equal pieces.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structaudit.llm.common import shared_folder, slices, text_rows

#: Words of a piece; longer items overlap by half. Pieces below ``SHORTEST`` words must occur word by word,
#: and those below ``SENTENCE`` words be all that a document holds.
PIECE, SHORTEST, SENTENCE = 128, 8, 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the best possible score from which on a document counts as contaminated. The seeds rely on one half.
THRESHOLD = 0.5
#: An alignment above the threshold spans at most two pieces of text, so it lies whole in one passage of four, begun every two.
STEP, PASSAGE = 2 * PIECE, 4 * PIECE
GAPS = (1, 2)
#: Bits of the bitmap of pairs (a power of two), bytes of text looked at together, cells of alignments made together.
BITS, TEXT_BYTES, CELLS = 1 << 26, 1_000_000, 1_000_000
#: Code points cut into words at a time.
CHUNK = 1 << 20
WORD, NO_WORD = re.compile(r"\w+"), re.compile(r"\W")


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts in a row as 64-bit numbers, never zero, the same in every task; and each text's count."""
    lower = [(t or "").lower() for t in texts]
    ends, text = np.cumsum([len(t) + 1 for t in lower]), "\n".join(lower)
    at, starts, numbers = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while at < len(text):
        cut = NO_WORD.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        start, number = _numbered(np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32))
        starts.append(start + at)
        numbers.append(number)
        at = end
    return np.concatenate(numbers), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of each word: a polynomial over its code points, by differences of running sums."""
    found = np.flatnonzero(np.bincount(codes))
    letter = np.zeros(found[-1] + 1, bool)
    letter[found] = [WORD.match(chr(c)) is not None for c in found.tolist()]
    edges = np.flatnonzero(np.diff(letter[codes], prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    powers, inverses = _powers(1 << int(len(codes) - 1).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    return start, mixed((sums[end] - sums[start]) * inverses[start]) | np.uint64(1)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))


def mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = numbers * np.uint64(0x9E3779B97F4A7C15)
    numbers = (numbers ^ (numbers >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return numbers ^ (numbers >> np.uint64(32))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit number for each ordered pair of words; zero if one of them is none."""
    code = mixed((first * np.uint64(0xD6E8FEB86659FD93)) ^ second)
    code[code == 0] = 1
    return np.where((first != 0) & (second != 0), code, np.uint64(0))


def pairs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words after it, number) of every pair of words one or two apart."""
    made = [(np.arange(max(0, len(words) - g)), g, paired(words[:-g], words[g:])) for g in GAPS]
    place, number = np.concatenate([m[0] for m in made]), np.concatenate([m[2] for m in made])
    return place, np.repeat(GAPS, [len(m[0]) for m in made]), number


def whole(words: np.ndarray) -> np.ndarray:
    """The seed of a text that holds nothing but these one or two words."""
    return paired(words[:1] ^ np.uint64(0x5851F42D4C957F2D), words[-1:] ^ np.uint64(len(words)))


def seeding(size: int) -> tuple[int, int]:
    """(places of a piece that get seeds, places of them that an alignment above the threshold hits at least)."""
    if size < SHORTEST:
        return 1, 1
    sure = -(-size // 2) - 1
    spared = 3 * sure // 4
    return size - 1 - spared, sure - spared


def aligned(piece: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score with each window (Smith-Waterman, linear gaps): of one piece, or of
    a row of ``piece`` for each window. Zero is no word and matches nothing."""
    text = np.zeros((len(windows), max(map(len, windows))), piece.dtype)
    for i, w in enumerate(windows):
        text[i, : len(w)] = w
    slope = np.arange(text.shape[1] + 1, dtype=np.int16) * np.int16(-GAP)
    row, best = np.zeros((len(windows), text.shape[1] + 1), np.int16), np.zeros(len(windows), np.int16)
    for w in np.atleast_2d(piece).T:
        w = w[:, None]
        new = np.zeros_like(row)
        match = np.where((text == w) & (w != 0), np.int16(MATCH), np.int16(MISMATCH))
        np.maximum(row[:, :-1] + match, row[:, 1:] + np.int16(GAP), out=new[:, 1:])
        np.maximum(new, 0, out=new)
        # Gaps along the text: the best earlier cell, less one gap for each step from it.
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(best, row.max(axis=1), out=best)
    return best


def contaminated_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, seeds): documents that hold a test item or an edited copy of one.

    Words are runs of letters and digits in lower case. The score is the best alignment of a piece of the item
    over the best possible one: 1.0 for a copy, at least 0.5 in every row. ``seeds`` is the number of seeded
    places of a piece that a passage hits. One row for each pair. Items of fewer than eight words are matched
    only word by word, and those of one or two words only by documents that hold nothing else.
    Null or empty texts match nothing. Repeated rows count once; a null doc_id or item_id is carried as
    null. Extra columns are ignored. An empty table on either side gives no rows.
    """
    rows = text_rows(docs)
    named = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").distinct()
    stored = _Store(docs.sparkSession)
    pieces = stored(named.mapInArrow(_cut, "item_id bigint, piece binary, words binary, size int").distinct())
    single = pieces.dropDuplicates(["piece"]).select("piece", "words", "size")
    pairs = stored(single.mapInArrow(_pairs_of_pieces, "piece binary, keep int, need int, place int, pair bigint"))
    counts = rows.mapInArrow(_counter(_bitmap(pairs)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    seeds = stored(_rarest(pairs, counts))
    least = seeds.agg(F.min("need").alias("need")).first()["need"] or 1
    bits = _bitmap(seeds)
    passages = stored(rows.mapInArrow(_passages(bits, least), "doc_id bigint, passage binary, pairs array<bigint>"))

    hit = passages.select("passage", "pairs").dropDuplicates(["passage"]).select("passage", F.explode("pairs").alias("pair"))
    # A piece has at most 127 places: two longs hold them.
    low = F.expr("bit_or(if(place < 64, shiftleft(1L, place), 0L))")
    high = F.expr("bit_or(if(place < 64, 0L, shiftleft(1L, place - 64)))")
    met = hit.join(seeds, "pair").groupBy("passage", "piece", "need").agg(low.alias("low"), high.alias("high"))
    met = met.withColumn("seeds", (F.bit_count("low") + F.bit_count("high")).cast("bigint")).where("seeds >= need")
    met = stored(met.select("passage", "piece", "seeds"))
    wanted = _bitmap(met.select(F.xxhash64("passage").alias("pair")))
    texts = rows.mapInArrow(_passage_words(bits, least, wanted), "passage binary, text binary").dropDuplicates(["passage"])
    both = met.join(single, "piece").join(texts, "passage")
    scored = both.select("passage", "piece", "seeds", "words", "text").mapInArrow(_scores, "passage binary, piece binary, seeds bigint, score double")
    named_scores = scored.join(pieces.select("item_id", "piece"), "piece").join(passages.select("doc_id", "passage"), "passage")
    return named_scores.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("seeds").alias("seeds"))


class _Store:
    """Writes tables to the shared folder and goes on from the files, whichever executor is lost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, f"{shared_folder(spark)}/decontamination-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.number += 1
        df.write.parquet(f"{self.folder}/{self.number}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.number}")


def _rarest(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(pair, piece, place, need) of the rarest places of each piece; a place is as common as the commoner of its pairs."""
    costs = pairs.join(counts, "pair", "left").groupBy("piece", "keep", "need", "place")
    costs = costs.agg(F.max(F.coalesce("n", F.lit(0))).alias("cost"), F.collect_set("pair").alias("pairs"))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("cost", "place"))
    kept = costs.withColumn("rank", rank).where("rank <= keep")
    return kept.select(F.explode("pairs").alias("pair"), "piece", "place", "need")


def _bitmap(pairs: DataFrame):
    """A broadcast bitmap of the pairs by their highest bits; its parts of 4 kB are made by Spark."""
    slot = F.shiftrightunsigned(F.col("pair"), 65 - BITS.bit_length()) + 1
    parts = pairs.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("at"))
    bits = np.zeros((BITS // 32_768, 4_096), np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        bits[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def _known(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = (numbers >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    return (numbers != 0) & ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _key(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def _cut(batches):
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of([text.as_py()])[0]
            made = [words[at : at + PIECE] for at in range(0, max(1, len(words) - PIECE // 2), PIECE // 2) if len(words)]
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array([item] * len(made), pa.int64()), "piece": pa.array([_key(w) for w in made], pa.binary()),
                 "words": pa.array([w.tobytes() for w in made], pa.binary()), "size": pa.array([len(w) for w in made], pa.int32())}
            )


def _pairs_of_pieces(batches):
    for batch in batches:
        for key, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = np.frombuffer(stored, np.uint64)
            place, _, number = pairs_of(words) if len(words) >= SENTENCE else (np.zeros(1, np.int64), None, whole(words))
            keep, need = seeding(len(words))
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array([key] * len(place), pa.binary()), "keep": pa.array([keep] * len(place), pa.int32()),
                 "need": pa.array([need] * len(place), pa.int32()), "place": pa.array(place, pa.int32()), "pair": pa.array(number.view(np.int64))}
            )


def _worded(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of bounded bytes together: ids, their words in a row with two zeros after each, starts and word counts."""
    gap = max(GAPS)
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
        for start, end in slices(sizes, TEXT_BYTES):
            numbers, counts = words_of(batch.column(1).slice(start, end - start).to_pylist())
            words = np.zeros(len(numbers) + gap * len(counts), np.uint64)
            words[np.arange(len(numbers)) + gap * np.repeat(np.arange(len(counts)), counts)] = numbers
            yield batch.column(0).slice(start, end - start), words, np.cumsum(counts + gap) - counts - gap, counts


def _hits(bits: np.ndarray, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words after it, number) of the pairs in the bitmap, and of texts of one or two words in it as a whole."""
    place, gap, number = pairs_of(words)
    tiny = np.flatnonzero((counts > 0) & (counts < SENTENCE))
    place, gap = np.append(place, starts[tiny]), np.append(gap, counts[tiny] - 1)
    number = np.concatenate([number, *[whole(words[starts[t] : starts[t] + counts[t]]) for t in tiny]])
    found = np.flatnonzero(_known(bits, number))
    return place[found], gap[found], number[found]


def _counter(held):
    def run(batches):
        for _, words, starts, counts in _worded(batches):
            number, n = np.unique(_hits(held.value, words, starts, counts)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    return run


def _passages(held, least: int):
    """The passages that at least ``least`` different seeds hit, with these seeds."""

    def run(batches):
        for ids, words, starts, counts in _worded(batches):
            owner, found, seeds = _hit_passages(held.value, least, words, starts, counts)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner, pa.int64())), pa.array([_key(w) for w in found], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                ["doc_id", "passage", "pairs"],
            )

    return run


def _passage_words(held, least: int, wanted):
    """The same passages with their words, if they are in the bitmap ``wanted``."""

    def run(batches):
        for _, words, starts, counts in _worded(batches):
            found = _hit_passages(held.value, least, words, starts, counts)[1]
            keys = [_key(w) for w in found]
            inside = _known(wanted.value, np.array([xxhash.xxh64_intdigest(k, 42) for k in keys], np.uint64)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, i in zip(keys, inside, strict=True) if i], pa.binary()),
                 pa.array([w.tobytes() for w, i in zip(found, inside, strict=True) if i], pa.binary())], ["passage", "text"],
            )

    return run


def _hit_passages(
    bits: np.ndarray, least: int, words: np.ndarray, starts: np.ndarray, counts: np.ndarray
) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Text, words and different seeds of each passage that at least ``least`` of them hit."""
    place, gap, number = _hits(bits, words, starts, counts)
    text = np.searchsorted(starts, place, side="right") - 1
    at = place - starts[text]
    part = at // STEP
    # A pair lies in the passage begun last and, unless it runs out of it, in the one before.
    before = (part > 0) & (at + gap < (part + 1) * STEP)
    text, part, number = np.append(text, text[before]), np.append(part, part[before] - 1), np.append(number, number[before])
    # A passage that ends where the one before it ends holds nothing new.
    new = (part == 0) | (part * STEP + PASSAGE - STEP < counts[text])
    order = np.lexsort((number[new], part[new], text[new]))
    text, part, number = text[new][order], part[new][order], number[new][order]
    moved = np.ones(len(text), bool)
    moved[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    fresh = moved.copy()
    fresh[1:] |= number[1:] != number[:-1]
    text, part, number, first = text[fresh], part[fresh], number[fresh], np.flatnonzero(moved[fresh])
    ends = np.append(first[1:], len(text))
    enough = ends - first >= least
    owner, found, seeds = [], [], []
    for lo, hi in zip(first[enough].tolist(), ends[enough].tolist(), strict=True):
        t, begin = text[lo], part[lo] * STEP
        owner.append(t)
        found.append(words[starts[t] + begin : starts[t] + min(counts[t], begin + PASSAGE)])
        seeds.append(number[lo:hi].view(np.int64))
    return owner, found, seeds


def _scores(batches):
    most = CELLS // PASSAGE
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            pieces = [np.frombuffer(w, np.uint64) for w in part.column(3).to_pylist()]
            sizes = np.array([len(p) for p in pieces])
            padded = np.zeros((len(pieces), sizes.max()), np.uint64)
            for i, p in enumerate(pieces):
                padded[i, : len(p)] = p
            best = aligned(padded, [np.frombuffer(w, np.uint64) for w in part.column(4).to_pylist()]) / (MATCH * sizes)
            enough = pa.array(best >= np.where(sizes < SHORTEST, 1.0, THRESHOLD))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).filter(enough) for i in range(3)], pa.array(best).filter(enough)], ["passage", "piece", "seeds", "score"]
            )
