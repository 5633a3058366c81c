"""Spelling variants: a vocabulary acceptor composed with a one-edit transducer and the acceptor again.

A pair of words at one edit agrees before the edit and after it. So the composition is cut by its
initial state: all words that share what lies before and after a window of places enter there
together, and what they hold inside the window is one minimised acceptor. Every pair is accepted in
exactly one window, the one that holds its first difference. Windows with many words are halved; a
window of one place holds no more words than there are letters to put there.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed, text_rows

RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: Every DAMAGE-th (document, run) by checksum loses a letter; 0 leaves all as they are.
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: Places of a window to begin with, and words of a window above which it is halved.
WINDOW, WORDS = 16, 2048
#: Different words a task counts before it hands its counts on.
HELD = 200_000


def _length(word: bytes) -> int:
    """Code points of letters in UTF-8; those beyond ASCII take two bytes."""
    return len(word) - word.count(b"\xc3")


def counted(doc_id: int | None, text: str | None, damage: int, into: dict[bytes, int]) -> None:
    """Add the words of one text, each run damaged as its checksum says, to ``into``."""
    if not text:
        return
    runs: dict[bytes, int] = {}
    # Case folding of bytes touches A-Z alone.
    for found in RUN.finditer(text.encode().lower()):
        run = found[0]
        if len(run) >= LEAST_LENGTH:
            runs[run] = runs.get(run, 0) + 1
    begun = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in runs.items():
        length = _length(run)
        if length < LEAST_LENGTH:
            continue
        if damage:
            h = zlib.crc32(run, begun)
            if h % damage == 0:
                letters, at = run.decode(), h % length
                run = (letters[:at] + letters[at + 1 :]).encode()
                if length == LEAST_LENGTH:
                    continue
        into[run] = into.get(run, 0) + n


def vocabulary(docs: DataFrame, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of at least six letters with at least five occurrences in all texts together."""

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            words = pa.array([w.decode() for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                counted(doc_id.as_py(), text.as_py(), damage, held)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    found = text_rows(docs).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def windows(shorter: int) -> list[tuple[int, int]]:
    """Windows over the places of a pair whose shorter word has that many letters: two at least."""
    parts = max(2, -(-shorter // WINDOW))
    cuts = [shorter * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def halves(low: int, high: int) -> list[tuple[int, int]]:
    return [(low, (low + high) // 2), ((low + high) // 2, high)]


def entry(word: str, shorter: int, low: int, high: int) -> tuple[bytes, str]:
    """What ``word`` shares with all words of a window (as a digest), and what it holds inside."""
    end = len(word) - (shorter - high)
    shared = xxhash.xxh3_128_digest(f"{shorter} {low} {high} {word[:low]} {word[end:]}".encode())
    return shared, word[low:end]


ENTRY = "key binary, shorter int, low int, high int, inside string, word string, n bigint"


def _entered(rows: list[tuple[str, int, int, int, int]]) -> pa.RecordBatch:
    made = [(*entry(w, s, a, b), w, n, s, a, b) for w, n, s, a, b in rows]
    key, inside, word, n, shorter, low, high = zip(*made, strict=True) if made else ((),) * 7
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    columns = [pa.array(c, k) for c, k in zip((key, shorter, low, high, inside, word, n), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["key", "shorter", "low", "high", "inside", "word", "n"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word in the windows of pairs in which it is the shorter or as long, or the longer by one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            yield _entered([
                (word, n, shorter, a, b)
                for word, n in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)
                for shorter in (len(word), len(word) - 1) if shorter >= LEAST_LENGTH for a, b in windows(shorter)
            ])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (5, 6, 1, 2, 3)]
        yield _entered([(w, n, s, a, b) for w, n, s, low, high in zip(*columns, strict=True) for a, b in halves(low, high)])


class Acceptor:
    """Minimised acyclic acceptors of sets of strings that share their states; equal states are one."""

    def __init__(self):
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list[str]] = {}

    def add(self, strings: list[str]) -> int:
        """The state that accepts exactly ``strings``."""
        return self._state(sorted(strings), 0, len(strings), 0)

    def _state(self, strings: list[str], low: int, high: int, depth: int) -> int:
        """The state that accepts the rests, from ``depth`` on, of a run of sorted strings."""
        final, moves = low < high and len(strings[low]) == depth, {}
        at = low + final
        while at < high:
            letter, begun = strings[at][depth], at
            while at < high and strings[at][depth] == letter:
                at += 1
            moves[letter] = self._state(strings, begun, at, depth + 1)
        same = (final, *moves.items())
        if same not in self._known:
            self._known[same] = len(self.moves)
            self.moves.append(moves)
            self.final.append(final)
        return self._known[same]

    def common(self, a: int, b: int) -> list[str]:
        """The strings that both states accept: the composition after its edit, where only equal letters move."""
        if a > b:
            a, b = b, a
        found = self._common.get((a, b))
        if found is None:
            found = [""] if self.final[a] and self.final[b] else []
            left, right = self.moves[a], self.moves[b]
            if len(left) > len(right):
                left, right = right, left
            for letter, to in left.items():
                if letter in right:
                    found += [letter + rest for rest in self.common(to, right[letter])]
            self._common[a, b] = found
        return found


def accepted(inside: list[str], width: int, last: bool) -> Iterator[tuple[str, str]]:
    """Pairs of one window at one edit, each once: strings of ``width`` letters with each other and with longer ones.

    Before the edit both sides read the same. A replacement moves them by two letters of the same state,
    an insertion moves only the longer side. Behind all of the shorter string a letter is inserted only
    in the ``last`` window; in any other the first difference of such words lies further on.
    """
    acceptor = Acceptor()
    short = acceptor.add([x for x in inside if len(x) == width])
    long = acceptor.add([x for x in inside if len(x) > width])
    todo = [(short, "")]
    while todo:
        state, read = todo.pop()
        moves = list(acceptor.moves[state].items())
        for i, (letter, to) in enumerate(moves):
            todo.append((to, read + letter))
            for other, beside in moves[i + 1 :]:
                for rest in acceptor.common(to, beside):
                    yield read + letter + rest, read + other + rest
    both = [(short, long, "")]
    while both:
        state, longer, read = both.pop()
        for letter, beside in acceptor.moves[longer].items():
            if letter in acceptor.moves[state]:
                both.append((acceptor.moves[state][letter], beside, read + letter))
            for rest in acceptor.common(state, beside):
                if rest[:1] != letter and (rest or last):
                    yield read + rest, read + letter + rest


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each window and word: how many near words it has there, and the one of largest n."""
    for batch in batches:
        words, ns, best, near = [], [], [], []
        for last, width, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            by_inside = {h["inside"]: (-h["n"], h["word"]) for h in held}
            found: dict[str, list] = {}
            for pair in accepted(list(by_inside), width, last):
                for one, other in (pair, pair[::-1]):
                    seen = found.setdefault(one, [0, by_inside[other]])
                    seen[0] += 1
                    seen[1] = min(seen[1], by_inside[other])
            for inside, (n, (count, word)) in found.items():
                words.append(by_inside[inside][1])
                ns.append(n)
                best.append(-count)
                near.append(word)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(best, pa.int64()), pa.array(near, pa.string())],
            ["word", "n_near", "near_n", "near"],
        )


def near_words(words: DataFrame, most: int = WORDS) -> DataFrame:
    """(word, n_near, near_n, near) for words (word, n) with near ones: their number, and the largest of them.

    Of equal counts the smaller word in code-point order is taken.
    """
    entered, ready = words.select("word", "n").mapInArrow(_first, ENTRY), None
    while True:
        sizes = entered.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("high") - F.col("low")).alias("places"))
        sizes = checkpointed(sizes.where("size > 1"))
        full = (F.col("size") > most) & (F.col("places") > 1)
        met = entered.join(sizes.where(~full).select("key"), "key")
        ready = met if ready is None else ready.union(met)
        hot = sizes.where(full).select("key")
        if hot.isEmpty():
            break
        # Rounds end with windows of one place.
        entered = checkpointed(entered.join(hot, "key").select(entered.columns).mapInArrow(_halved, ENTRY))
    # Only as many as WORDS, or as there are letters for one place, come together here.
    held = ready.groupBy("key").agg(
        (F.max("high") == F.max("shorter")).alias("last"), F.max(F.col("high") - F.col("low")).alias("width"),
        F.collect_list(F.struct("inside", "n", "word")).alias("held"),
    ).select("last", "width", "held")
    found = held.mapInArrow(_composed, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.down")).alias("near_n"), F.col("best.near").alias("near"),
    )


def spelling_groups(docs: DataFrame, damage: int = DAMAGE, most: int = WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the texts.

    Words are runs of Latin letters, A-Z in lower case, of at least six letters and with at least five
    occurrences. Near words differ by one inserted, deleted or replaced letter. The form of a word is
    its near word with the largest n, if that is five times its own or more; the root is where forms
    lead. Null and empty texts hold no words; repeated rows count each time; a null doc_id reads as
    nothing in the checksum; texts and runs of any length count whole; extra columns are ignored; an
    empty table gives no rows.
    """
    words = checkpointed(vocabulary(docs, damage))
    near = near_words(words, most)
    is_form = F.col("near_n") >= F.col("n") * FORM_RATIO
    found = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    ))
    # Each step multiplies n by five at least, so this many steps reach every root; each round doubles them.
    most_n = found.agg(F.max("form_n")).first()[0] or 1
    steps = 1 + int(math.log(max(1, most_n), FORM_RATIO))
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, steps).bit_length()):
        onward = links.select(F.col("word").alias("w"), F.col("root").alias("r"))
        links = checkpointed(links.join(onward, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root")))
    return found.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"),
    )
