"""Secret scans: patterns propose, a random forest trained on labelled findings removes false positives."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed, slices, text_rows

#: A candidate: a run of key characters, 16 or more of them, with a digit in it. ``=`` only pads its end: one
#: with more characters or an opening quote behind it assigns, and the name before it is context.
RUN = r"[A-Za-z0-9+/_-]{16,}"
CANDIDATE = re.compile(rf"(?<=[\"'`]){RUN}=*(?=[\"'`])|(?<![A-Za-z0-9+/_-]){RUN}(?:=+(?![A-Za-z0-9+/_=\"'`-]))?")
CREDENTIAL = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|bearer|auth)", re.I)
PLACEHOLDER = re.compile(r"(?:example|sample|dummy|placeholder|test|changeme|your|xxx|todo|redacted)", re.I)
DIGEST = re.compile(r"(?:commit|sha\d*|md5|checksum|digest|uuid|guid|etag|revision|hash|isbn|order|card|phone)", re.I)
LINK = re.compile(r"(?:https?:|www\.|://|@|href|src=)", re.I)
#: A credential's own name, assigned right before the value, with or without a quote.
NAMED = re.compile(rf"{CREDENTIAL.pattern}[\w.\-]*[\"'`\])]*\s*(?:=>|:=|=|:)\s*(?:bearer\s+)?[\"'`]?$", re.I)
ASSIGNED = re.compile(r"[\w.\-\"']\s*(?:=>|:=|=|:)\s*[\"'`]?$")
TESTS = re.compile(r"(?:^|[/_.\-])(?:test|tests|spec|example|examples|sample|fixture|docs?)(?:[/_.\-]|$)", re.I)
NEAR = 48
#: Findings that the forest is trained on at most (in expectation), labels of both kinds alike.
TRAINING = 20_000
TREES, DEPTH, SEED = 40, 8, 11
TEXT_BYTES = 4_000_000
GRAM = 4
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "other", "changes", "longest_letters", "transition", "dictionary", "hex",
    "distinct", "credential", "placeholder", "digest", "link", "assigned", "quoted", "word_before", "test_path", "path_depth",
    "named",
)
_CLASS = np.full(256, 3, np.int64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 0, 1, 2


class Corpus:
    """Character transitions and letter runs of all texts: two tables of fixed size."""

    def __init__(self, pairs: np.ndarray, grams: np.ndarray):
        rows = pairs + 1.0
        self.step = np.log(rows / rows.sum(axis=1, keepdims=True))
        self.common = grams >= max(3, grams.sum() * 1e-7)


def _symbols(data: np.ndarray) -> np.ndarray:
    """0 for all but letters (1 to 26, either case) and digits (27)."""
    table = np.zeros(256, np.int64)
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[48:58] = 27
    return table[data]


def _grams(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of four letters, and where they start."""
    n = len(symbols) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, inside = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(GRAM):
        s = symbols[i : i + n]
        inside &= (s > 0) & (s < 27)
        code = code * 26 + s - 1
    at = np.flatnonzero(inside)
    return code[at], at


def _statistics(batches):
    pairs, grams = np.zeros(28 * 28, np.int64), np.zeros(26**GRAM, np.int64)
    for batch in batches:
        texts = batch.column(0).cast(pa.large_binary())
        for i, j in slices(pa.compute.binary_length(texts).to_pylist(), TEXT_BYTES):
            symbols = _symbols(np.frombuffer(b"\n".join(texts.slice(i, j - i).to_pylist()), np.uint8))
            pairs += np.bincount(symbols[:-1] * 28 + symbols[1:], minlength=28 * 28)
            grams += np.bincount(_grams(symbols)[0], minlength=26**GRAM)
    for kind, counts in ((0, pairs), (1, grams)):
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(counts[some])], ["kind", "code", "n"]
        )


def corpus_of(docs: DataFrame) -> Corpus:
    """Counts over the whole of all texts."""
    rows = text_rows(docs, "text").where("text is not null").mapInArrow(_statistics, "kind int, code bigint, n bigint")
    pairs, grams = np.zeros(28 * 28), np.zeros(26**GRAM)
    for r in rows.groupBy("kind", "code").agg(F.sum("n").alias("n")).collect():
        (grams if r["kind"] else pairs)[r["code"]] = r["n"]
    return Corpus(pairs.reshape(28, 28), grams)


def features(value: str, before: str, after: str, path: str, corpus: Corpus) -> list[float]:
    """Numbers for one candidate, in the order of FEATURES."""
    data = np.frombuffer(value.encode(), np.uint8)
    kinds, n = _CLASS[data], len(data)
    share = np.bincount(kinds, minlength=4) / n
    p = np.bincount(data)[np.unique(data)] / n
    symbols = _symbols(data)
    letters = np.concatenate([[0], (kinds == 1) | (kinds == 2), [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(letters))
    code, at = _grams(symbols)
    covered = np.zeros(n, bool)
    for a in at[corpus.common[code]].tolist():
        covered[a : a + GRAM] = True
    word = re.findall(r"[A-Za-z_\-]+", before)
    return [
        float(n), float(-(p * np.log2(p)).sum()), *share[[0, 1, 2, 3]].tolist(), float((kinds[1:] != kinds[:-1]).mean()),
        float((edges[1::2] - edges[::2]).max(initial=0)), float(corpus.step[symbols[:-1], symbols[1:]].mean()), float(covered.mean()),
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float(len(np.unique(data)) / n),
        float(CREDENTIAL.search(before) is not None), float(PLACEHOLDER.search(before + value + after) is not None),
        float(DIGEST.search(before) is not None), float(LINK.search(before[-16:] + after[:8]) is not None),
        float(ASSIGNED.search(before) is not None), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before != "" and after != ""),
        float(len(word[-1]) if word else 0), float(TESTS.search(path) is not None), float(path.count("/")),
        float(NAMED.search(before) is not None),
    ]


def find_candidates(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, start, end, value, before, after, x): every candidate with its features.

    Places count code points.
    """
    held = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches):
        corpus = held.value
        for batch in batches:
            rows = []
            for doc, text, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for m in CANDIDATE.finditer(text):
                    value = m.group()
                    if any(c in "0123456789" for c in value):
                        before, after = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
                        rows.append((doc, m.start(), m.end(), value, before, after, features(value, before, after, path or "", corpus)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "value", "before", "after", "x"]
            )

    schema = "doc_id bigint, start bigint, end bigint, value string, before string, after string, x array<double>"
    return text_rows(docs, "doc_id", "text", "source").where("text is not null").mapInArrow(run, schema)


def reviewed(x: Column) -> Column:
    """Label of a finding from review rules: 1 secret, 0 none, null undecided.

    A random value assigned to a credential's name, quoted or not, is a secret. A value that mostly reads like
    words, all digits, part of a link or placeholder, or that nothing assigns, is none.
    """
    f = {name: x[i] for i, name in enumerate(FEATURES)}
    random = (f["entropy"] > 3.0) & (f["dictionary"] < 0.4) & (f["digits"].between(0.05, 0.95))
    quoted = (f["credential"] == 1) & (f["assigned"] == 1) & (f["quoted"] == 1)
    secret = (quoted | ((f["named"] == 1) & (f["link"] == 0))) & random & (f["placeholder"] == 0)
    none = (f["digits"] == 1) | (f["link"] == 1) | (f["dictionary"] > 0.7) | ((f["credential"] == 0) & (f["assigned"] == 0))
    return F.when(secret, 1.0).when(none, 0.0)


def training_rows(rows: DataFrame) -> tuple[DataFrame, set[float]]:
    """What the forest is trained on, of (x, label); and the labels that occur.

    Copies of a finding teach nothing new: one row for each set of features and label, then a fixed
    draw by the number of those rows.
    """
    rows = checkpointed(rows.distinct())
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return rows, set()
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, TRAINING / 2 / n))])
    return rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("label")]), set(counts)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, value, score, is_secret): every candidate, judged by the forest.

    ``labelled`` holds reviewed findings (doc_id, start, label 0 or 1); without it, :func:`reviewed` labels
    those candidates that it can. If only one label occurs, every score is that label; with no label
    at all the score is null and ``is_secret`` true, as nothing is known to be a false positive.
    Null and empty texts have no candidates; a null source is an empty path; repeated rows are answered
    one by one; extra columns are ignored; an empty table gives no rows.
    """
    found = checkpointed(find_candidates(docs, corpus_of(docs)))
    if labelled is None:
        rows = found.select("x", reviewed(F.col("x")).alias("label")).where("label is not null")
    else:
        marks = labelled.select(F.col("doc_id").cast("bigint"), F.col("start").cast("bigint"), F.col("label").cast("double"))
        rows = found.join(marks, ["doc_id", "start"]).select("x", "label")
    drawn, labels = training_rows(rows)
    if len(labels) < 2:
        score = F.lit(next(iter(labels), None)).cast("double")
        out = found.withColumn("score", score)
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="f", labelCol="label", maxMemoryInMB=128)
        model = forest.fit(drawn.select(array_to_vector("x").alias("f"), "label"))
        judged = model.transform(found.withColumn("f", array_to_vector("x")))
        out = judged.withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return out.select("doc_id", "start", "end", "value", "score", F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("is_secret"))
