"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts the common subsequences of three letters of two words, each discounted by the
places it spreads over; what is no letter costs a gap and counts for nothing else, so an insult with
inserted or dotted letters stays close to itself. A sentence is as toxic as its worst word, a
text as its worst sentence.

Labels belong to texts, so the words that earn a label are found in turns: the machine is fitted, and
the words of toxic texts that it finds worst are the examples of the next turn; all words of clean
texts are counterexamples. The decision function is linear in the subsequences of the landmarks,
so a word is scored by one look into a table for each of its subsequences.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import slices, text_rows

#: Discount for each place a subsequence spreads beyond three; letters and places it may spread over.
DECAY, SPREAD, PLACES = 0.7, 7, 16
#: Letters of a unit; longer words are cut into units that overlap by half.
UNIT = 24
LANDMARKS = 192
#: Labelled texts of each kind that a fit sees at most, and their size at most.
SAMPLE, SAMPLE_BYTES = 2_000, 32_768
#: Counterexamples of one turn, and turns.
CLEAN_WORDS, TURNS = 8_000, 4
PENALTY = 20.0
#: Scored words a task keeps; text it takes at once.
HELD, TEXT_BYTES, CELLS = 200_000, 2_000_000, 2_000_000
THRESHOLD = 0.3

BEGIN, DIGIT, LATIN, OTHER, CODES = 27, 28, 29, 62, 64
#: Single characters between blanks, three at least: letters that were spaced out.
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


@functools.cache
def _codes() -> np.ndarray:
    """A number for every character below U+10000; 0 for what is no letter or digit."""
    made = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isdigit():
            made[i] = DIGIT
        elif c.isalpha():
            made[i] = i - 96 if "a" <= c <= "z" else LATIN + i - 0xDF if 0xDF <= i <= 0xFF else OTHER + i % 2
    return made


@functools.cache
def _latin() -> bytes:
    return _codes()[:256].tobytes()


def _lettered(word: str) -> bytes:
    """A code for each character of a word; 0 for what is no letter, none of it at either end."""
    try:
        return word.encode("latin-1").translate(_latin()).strip(b"\0")
    except UnicodeEncodeError:
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(points < 1 << 16, _codes()[np.minimum(points, 0xFFFF)], OTHER).astype(np.uint8).tobytes().strip(b"\0")


def units(word: str) -> list[tuple[bytes, bytes | None]]:
    """The word cut into units: codes from a begin mark on, and places where letters are not side by side."""
    codes = _lettered(word)
    if len(codes) <= UNIT and 0 not in codes:
        return [(b"\x1b" + codes, None)] if len(codes) > 1 else []
    letters = np.frombuffer(codes, np.uint8)
    places, out = np.flatnonzero(letters), []
    letters = letters[places]
    for at in range(0, max(1, len(letters) - UNIT // 2), UNIT // 2):
        part, where = letters[at : at + UNIT], places[at : at + UNIT]
        if at == 0:
            part, where = np.append(np.uint8(BEGIN), part), np.append(-1, where)
        if len(part) < 3:
            continue
        where = np.minimum(where - where[0], 255).astype(np.uint8)
        out.append((part.tobytes(), None if where[-1] == len(where) - 1 else where.tobytes()))
    return out


@functools.cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    keep = (i < j) & (j < k) & (k - i < SPREAD)
    return i[keep], j[keep], k[keep]


def _subsequences(parts: list[tuple[bytes, bytes | None]]):
    """Over units in groups of one length: their numbers, codes of subsequences, weights of norm one."""
    groups: dict[tuple[int, bool], list[int]] = {}
    for at, (codes, places) in enumerate(parts):
        groups.setdefault((len(codes), places is None), []).append(at)
    for (n, plain), members in groups.items():
        i, j, k = _triples(n)
        for low in range(0, len(members), max(1, CELLS // len(i))):
            some = members[low : low + max(1, CELLS // len(i))]
            codes = np.frombuffer(b"".join(parts[m][0] for m in some), np.uint8).reshape(-1, n).astype(np.int32)
            if plain:
                spread = (k - i - 2)[None, :]
            else:
                places = np.frombuffer(b"".join(parts[m][1] for m in some), np.uint8).reshape(-1, n).astype(np.int32)
                spread = places[:, k] - places[:, i] - 2
            weight = np.where(spread < PLACES, np.power(DECAY, spread), 0).astype(np.float32)
            norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
            weight = weight / np.maximum(norm, 1e-12)
            yield np.array(some), (codes[:, i] * CODES + codes[:, j]) * CODES + codes[:, k], weight


def worst(table: np.ndarray, words: list[str]) -> np.ndarray:
    """The largest value of the decision function (without its constant) over the units of each word."""
    parts, owner = [], []
    for at, word in enumerate(words):
        made = units(word)
        parts += made
        owner += [at] * len(made)
    values = np.zeros(len(parts), np.float32)
    for some, codes, weight in _subsequences(parts):
        values[some] = (table[codes] * weight).sum(axis=1)
    out = np.full(len(words), -np.inf, np.float32)
    np.maximum.at(out, np.array(owner, np.int64), values)
    return np.where(np.isfinite(out), out, 0)


def words_of(text: str | None) -> set[str]:
    """Different words of a sentence or text in lower case, spaced-out letters joined."""
    if not text:
        return set()
    text = text.lower()
    words = set(text.split())
    for run in SPACED.finditer(text):
        words.add("".join(run[0].split()))
    return words


@dataclass
class Model:
    table: np.ndarray
    constant: float
    slope: float
    offset: float

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (values + self.constant) + self.offset, -30, 30)))


def _features(words: list[str], index: np.ndarray, width: int) -> np.ndarray:
    """A row for each word: weights of the subsequences that ``index`` numbers; of several units the first."""
    first = [(units(w) or [(b"", None)])[0] for w in words]
    some = [i for i, (codes, _) in enumerate(first) if len(codes) >= 3]
    out = np.zeros((len(words), width), np.float32)
    for rows, codes, weight in _subsequences([first[i] for i in some]):
        at, weight = index[codes], np.broadcast_to(weight, codes.shape)
        keep = at >= 0
        np.add.at(out, (np.repeat(np.array(some)[rows], codes.shape[1]).reshape(codes.shape)[keep], at[keep]), weight[keep])
    return out


def _landmarks(bad: list[str], clean: list[str], most: int) -> list[str]:
    half = most // 2
    return list(dict.fromkeys(bad[:half] + clean[: most - min(half, len(bad))]))


def _machine(bad: list[str], clean: list[str], marks: list[str]) -> tuple[np.ndarray, float]:
    """The table of the decision function and its constant: squared hinge loss on Nyström features, by Newton steps."""
    index = np.full(CODES**3, -1, np.int32)
    seen = np.unique(np.concatenate([codes.ravel() for _, codes, _ in _subsequences([u for w in marks for u in units(w)[:1]])]))
    index[seen] = np.arange(len(seen))
    basis = _features(marks, index, len(seen))
    value, vector = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = value > 1e-4 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    words = bad + clean
    kernel = np.concatenate([_features(words[i : i + 512], index, len(seen)) @ basis.T for i in range(0, len(words), 512)])
    x = np.hstack([kernel @ root, np.ones((len(words), 1))])
    y = np.append(np.ones(len(bad)), -np.ones(len(clean)))
    weight = PENALTY * np.append(np.full(len(bad), 0.5 / len(bad)), np.full(len(clean), 0.5 / len(clean))) * np.sqrt(len(words))
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):
        margin = y * (x @ w)
        on = margin < 1
        gradient = ridge * w - 2 * x[on].T @ (weight[on] * y[on] * (1 - margin[on]))
        curve = np.diag(ridge) + 2 * (x[on] * weight[on, None]).T @ x[on]
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    table = np.zeros(CODES**3, np.float32)
    table[seen] = (root @ w[:-1]) @ basis
    return table, float(w[-1])


def _grams(word: str) -> set[str]:
    marked = f"^{word}"
    return {marked[i : i + 5] for i in range(max(1, len(marked) - 4))}


def _telling(toxic: list[set[str]], clean: list[set[str]]) -> dict[str, float]:
    """How much more often a run of five letters occurs in toxic texts than chance; one value for each run seen there."""
    counts: list[dict[str, int]] = [{}, {}]
    for kind, texts in enumerate((toxic, clean)):
        for words in texts:
            for gram in set().union(*map(_grams, words)) if words else ():
                counts[kind][gram] = counts[kind].get(gram, 0) + 1
    n, m = len(toxic) + 1, len(clean) + 1
    return {g: k * np.log((k + 0.5) / n * m / (counts[1].get(g, 0) + 0.5)) for g, k in counts[0].items()}


def fit(labelled: list[tuple[int, str]], share: float | None = None) -> Model:
    """A model from (label, sentence or text) rows; ``share`` is the part of label 1 in all rows, if it differs from these."""
    rows = sorted({(text, int(label)) for label, text in labelled if text})
    bags = [(label, words_of(text)) for text, label in rows]
    toxic, clean = ([words for kind, words in bags if kind == k and words] for k in (1, 0))
    rate = len(toxic) / max(1, len(toxic) + len(clean)) if share is None else share
    if not toxic or not clean:
        return Model(np.zeros(CODES**3, np.float32), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    # Every fifth text is kept for calibration, where there are enough.
    apart = len(toxic) >= 50 and len(clean) >= 50
    learn_t, learn_c = ([w for i, w in enumerate(bag) if not apart or i % 5] for bag in (toxic, clean))
    telling = _telling(learn_t, learn_c)
    everything = sorted(set().union(*learn_c))
    worth = {w: max(map(telling.__getitem__, _grams(w))) for words in learn_t for w in words}
    first = {max(sorted(words), key=worth.__getitem__) for words in learn_t}
    common = set(everything)
    # What tells several toxic texts apart; a text without such a word has to wait for the machine.
    least = 2 * np.log(1.5 / (len(learn_t) + 1) * (len(learn_c) + 1) / 0.5)
    bad = sorted((w for w in first if w not in common and worth[w] >= least), key=lambda w: (-worth[w], w))
    bad = bad or sorted(first, key=lambda w: (-worth[w], w))
    spread = [everything[i] for i in np.linspace(0, len(everything) - 1, min(CLEAN_WORDS // 2, len(everything))).astype(int)]
    hard: list[str] = []
    table, constant = np.zeros(CODES**3, np.float32), 0.0
    for _ in range(TURNS):
        against = list(dict.fromkeys(hard + spread))
        table, constant = _machine(bad, against, _landmarks(bad, against[:: max(1, len(against) // LANDMARKS)], LANDMARKS))
        values = worst(table, everything)
        hard = [everything[i] for i in np.argsort(-values)[: CLEAN_WORDS // 2]]
        pool = sorted(set().union(*learn_t) - common)
        value = dict(zip(pool, worst(table, pool).tolist(), strict=True))
        # Each toxic text gives its worst word if the machine agrees, and every other word on the far side of all clean ones.
        limit = max(-constant, float(values.max(initial=-np.inf)))
        found = {w for w in pool if value[w] > limit}
        for words in learn_t:
            own = [w for w in words if value.get(w, -np.inf) > -constant]
            if own and not found & words:
                found.add(max(sorted(own), key=value.__getitem__))
        found = found or set(bad)
        # Landmarks are the first of these: worst ones far apart in order.
        order = sorted(found, key=lambda w: (-value[w], w))
        bad = order[:: max(1, len(order) // LANDMARKS)] + [w for i, w in enumerate(order) if i % max(1, len(order) // LANDMARKS)]
    table, constant = _machine(bad, list(dict.fromkeys(hard + spread)), _landmarks(bad, hard[:: max(1, len(hard) // LANDMARKS)], LANDMARKS))
    tested = [(k, w) for k, bag in ((1, toxic), (0, clean)) for i, w in enumerate(bag) if not apart or i % 5 == 0]
    every = sorted(set().union(*[w for _, w in tested]))
    value = dict(zip(every, worst(table, every).tolist(), strict=True))
    top = np.array([max(map(value.__getitem__, w)) for _, w in tested]) + constant
    slope, offset = _calibrated(top, np.array([k for k, _ in tested], float))
    drawn = np.mean([k for k, _ in tested])
    offset += float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)) - np.log(drawn / (1 - drawn)))
    return Model(table, constant, slope, offset)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets drawn in from 0 and 1; the slope is never negative."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        curve = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, design.T @ (p - goal) + 1e-3 * theta)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(theta[0])), float(theta[1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels a query must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """A model from the texts whose doc_id has a label (doc_id, toxic) and for which ``may_learn`` holds.

    A doc_id with several labels counts as toxic if one of them says so. Of each kind at most ``SAMPLE``
    doc_ids are drawn by hash, whose text has at most ``SAMPLE_BYTES`` bytes; the share of labels is counted over all.
    """
    said = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    said = said.where("doc_id is not null and toxic in (0, 1)").where(may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [said.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    ids = drawn[0].union(drawn[1])
    rows = text_rows(docs).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(ids), "doc_id")
    found = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    total = sum(counts.values())
    return fit([(r["toxic"], r["text"]) for r in found], counts.get(1, 0) / total if total else 0.0)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst_unit) for every row of ``docs``: the probability of label 1, and the word that decided.

    Null, empty and wordless texts get what the constant alone gives; repeated rows are answered one
    by one; texts of any length are scored whole; extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        used, known = shared.value, {}
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for low, high in slices(sizes, TEXT_BYTES):
                bags = [words_of(t) for t in batch.column(1).slice(low, high - low).to_pylist()]
                if len(known) > HELD:
                    known = {}
                fresh = list(set().union(*bags) - known.keys())
                known.update(zip(fresh, worst(used.table, fresh).tolist(), strict=True))
                top = [max(b, key=lambda w: (known[w], w)) if b else None for b in bags]
                values = np.array([known[w] if w is not None else 0.0 for w in top])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(used.probability(values), pa.float64()), pa.array(top, pa.string())],
                    ["doc_id", "score", "worst_unit"],
                )

    return text_rows(docs).mapInArrow(run, "doc_id bigint, score double, worst_unit string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_unit) for every row of ``docs``, learned from the rows not held out."""
    scored = score_texts(docs, fit_documents(docs, labels, ~held_out(F.col("doc_id"))))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_unit",
    )
