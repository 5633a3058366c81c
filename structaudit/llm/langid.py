"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all documents that may be learned from. The weights come from a
bounded sample of them, by follow-the-regularised-leader with an elastic-net penalty (which leaves
most weights at zero); a part of the sample is set aside to calibrate the temperature.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import slices, text_rows

#: Hashed features, and the lengths of the n-grams.
FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: Labelled rows that the weights are fitted on, all languages together (in expectation), and
#: languages learned, the most frequent first.
SAMPLE, LANGUAGES = 6_000, 256
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
#: Characters handled together.
CHARACTERS = 2_000_000
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of what occurs, in that order, and whether each text has a letter."""
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    lengths = np.array([len(c) for c in coded], np.int64)
    chars = _letters()[np.concatenate(coded)] if lengths.sum() else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    lettered = np.bincount(owner[chars != 32], minlength=len(texts)) > 0
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (owner[1:] != owner[:-1])
    chars, owner = chars[keep].astype(np.uint64), owner[keep]
    found = []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m < 1:
            continue
        code = np.full(m, n, np.uint64)
        for i in range(n):
            code = (code ^ chars[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(32)
        inside = (owner[:m] == owner[n - 1 :]) & ((chars[:m] != 32) if n == 1 else True)
        found.append((owner[:m] * FEATURES + (code & np.uint64(FEATURES - 1)).astype(np.int64))[inside])
    both, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return both // FEATURES, both % FEATURES, count, lettered


def weighted(text: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF values, each text of length one."""
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n))
    return value / np.where(norm > 0, norm, 1)[text]


class Model:
    """Weights by feature and language; the last row is the bias."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros((FEATURES + 1, len(languages)), np.float64)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 17) -> None:
        """One pass over the rows per epoch, in a fixed random order; rows are (features, values, language)."""
        k = len(self.languages)
        z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
        rng = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                feature, value, y = rows[i]
                at, x = np.append(feature, FEATURES), np.append(value, 1.0)
                w = self._leader(z[at], n[at])
                p = _softmax((x @ w)[None, :])[0]
                p[y] -= 1
                g = x[:, None] * p
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
        self.weights = self._leader(z, n)

    @staticmethod
    def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights that minimise the regularised sum so far: zero where the gradients stay below L1."""
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def logits(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(self.weights[FEATURES], (n, 1))
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(text, weights=value * self.weights[feature, k], minlength=n)
        return out

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Temperature with the least loss on rows that were not fitted, by golden section.

        The truth counts as one error in n + 2, so that a sample without errors does not claim certainty.
        """
        if not rows:
            return
        logits = np.array([np.append(v, 1.0) @ self.weights[np.append(f, FEATURES)] for f, v, _ in rows])
        truth, doubt = np.array([y for _, _, y in rows]), 1 / (len(rows) + 2)

        def loss(t: float) -> float:
            p = np.log(np.maximum(_softmax(logits / math.exp(t)), 1e-300))
            right = p[np.arange(len(truth)), truth]
            wrong = (p.sum(axis=1) - right) / max(1, p.shape[1] - 1)
            return -float(((1 - doubt) * right + doubt * wrong).mean())

        low, high, ratio = -4.0, 2.0, (math.sqrt(5) - 1) / 2
        for _ in range(40):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = math.exp((low + high) / 2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _runs(texts) -> list[tuple[int, int]]:
    return list(slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), CHARACTERS))


def _frequencies(batches):
    """How many texts each feature occurs in, and how many texts there are (feature -1)."""
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for i, j in _runs(batch.column(0)):
            _, feature, _, _ = features(batch.column(0).slice(i, j - i).to_pylist())
            total += np.bincount(feature, minlength=FEATURES)
            n += j - i
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["feature", "n"])


def fit(docs: DataFrame) -> Model | None:
    """A model from rows with a language that are not held out; None if there are none."""
    learn = text_rows(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_lang = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not by_lang:
        return None
    counts = learn.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    df, total = np.zeros(FEATURES), 0
    for r in counts.collect():
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = sorted(by_lang)
    each = max(20, SAMPLE // len(languages))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / by_lang[lang]))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = learn.where(F.col("lang").isin(languages)).where(draw < share[F.col("lang")])

    def rows_of(batches):
        for batch in batches:
            for i, j in _runs(batch.column(1)):
                text, feature, count, _ = features(batch.column(1).slice(i, j - i).to_pylist())
                value = weighted(text, feature, count, idf, j - i)
                ends = np.searchsorted(text, np.arange(j - i + 1))
                parts = [(feature[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary()),
                     batch.column(2).slice(i, j - i)], ["doc_id", "feature", "value", "draw"],
                )

    code = {lang: i for i, lang in enumerate(languages)}
    key = F.xxhash64("text", "doc_id").alias("draw")
    drawn = sample.select("lang", "text", key).mapInArrow(rows_of, "lang string, feature binary, value binary, draw bigint").collect()
    drawn.sort(key=lambda r: (r["draw"], r["lang"]))
    rows = [(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["value"], np.float32).astype(float), code[r["lang"]]) for r in drawn]
    model = Model(languages, idf)
    aside = [r for i, r in enumerate(rows) if i % 5 == 0] if len(rows) >= 50 else []
    model.fit([r for i, r in enumerate(rows) if i % 5 or not aside])
    model.calibrate(aside)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; only the text decides.

    A null text or one without a letter is ``und`` with score 0; so is every row if nothing could
    be learned. Otherwise the score is the calibrated probability of the predicted language. Repeated rows are
    answered one by one, extra columns are ignored, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for i, j in _runs(batch.column(2)):
                n = j - i
                text, feature, count, lettered = features(batch.column(2).slice(i, n).to_pylist())
                names, score = [UNKNOWN] * n, np.zeros(n)
                if model is not None:
                    p = _softmax(model.logits(text, feature, weighted(text, feature, count, model.idf, n), n) / model.temperature)
                    best = p.argmax(axis=1)
                    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                    score = np.where(lettered, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = text_rows(docs).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
