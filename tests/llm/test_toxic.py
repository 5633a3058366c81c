"""Toxicity: the kernel against an enumeration of subsequences, the machine against the kernel, held-out rows."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from structaudit.llm import toxic
from structaudit.llm.common import table

LABELS = "doc_id bigint, toxic int, quality int, held_out string"


def embedded(word):
    """Weights of all subsequences of three letters, by definition."""
    letters = [("^", -1)] + [(c, i) for i, c in enumerate(word.strip("#.*-")) if c.isalnum()]
    out, norm = {}, 0.0
    for (i, (a, p)), (j, (b, _)), (k, (c, q)) in itertools.combinations(enumerate(letters), 3):
        if k - i < toxic.SPREAD and q - p - 2 < toxic.PLACES:
            weight = toxic.DECAY ** (q - p - 2)
            out[a + b + c] = out.get(a + b + c, 0) + weight
            norm += weight * weight
    return {g: v / math.sqrt(norm) for g, v in out.items()}


def kernel(a, b):
    x, y = embedded(a), embedded(b)
    return sum(v * y.get(g, 0) for g, v in x.items())


WORDS = ["idiot", "id*iot", "i.d.i.o.t", "idioot", "banana", "bananas", "scum", "worthless", "thereupon", "###idiot###", "ab"]


def test_kernel_equals_subsequences():
    index = np.arange(toxic.CODES**3, dtype=np.int32)
    got = toxic._features(WORDS, index, len(index))
    want = [[kernel(a, b) for b in WORDS] for a in WORDS]
    assert np.allclose(got @ got.T, want, atol=1e-5)
    assert want[0][2] > 0.9 and want[0][1] > 0.8 > want[0][4]


def test_table_is_the_machine_over_landmarks():
    bad, clean = ["idiot", "scum", "worthless"], ["banana", "thereupon", "inside", "mother", "within", "riot"]
    marks = [*bad, *clean]
    values, constant = toxic._machine(bad, clean, marks)
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    # The decision function lies in the span of the landmarks: values there fix it everywhere.
    at_marks = toxic.worst(values, marks)
    weights = np.linalg.lstsq(gram, at_marks, rcond=None)[0]
    for word in ("idio.t", "ridiot", "scums", "bandana", "zzz"):
        assert toxic.worst(values, [word])[0] == pytest.approx(sum(w * kernel(word, m) for w, m in zip(weights, marks)), abs=1e-3)
    assert (toxic.worst(values, bad) + constant > 0).all() and (toxic.worst(values, clean) + constant < 0).all()


def sentences(seed, n):
    r = random.Random(seed)
    parts = "lo mi ta re su ne vo ka pi du ser mon tal".split()
    insults = ["idiot", "scumbag", "worthless", "moron"]
    rows = []
    for i in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 20))]
        if i % 4 == 0:
            words[r.randrange(len(words))] = r.choice(insults)
        rows.append((int(i % 4 == 0), " ".join(words) + "."))
    return rows


def test_gapped_insults():
    # Words that share a stem with an insult are told apart where clean sentences hold them.
    model = toxic.fit(sentences(1, 400) + [(0, f"idle riot worth {i}") for i in range(5)])
    p = lambda text: float(model.probability(np.max(toxic.worst(model.table, sorted(toxic.words_of(text))), initial=-9)))
    for bad in ("you idiot", "an id-iot", "w.o.r.t.h.l.e.s.s", "i d i o t s", "MO*RON!", "scum_bag", "id​iot", "x" * 30 + "worthless" + "y" * 40):
        assert p(f"lomi {bad} tare") >= toxic.THRESHOLD, bad
    for good in ("lomi tare sune", "montal serdu", "mo ron", "idle riot worth"):
        assert p(good) < toxic.THRESHOLD, good
    wrong = sum((p(text) >= toxic.THRESHOLD) != bool(label) for label, text in sentences(2, 300))
    assert wrong <= 6


def test_held_out_rows_of_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = {r["doc_id"]: r for r in toxic.toxicity(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    tested = [(r["toxic"], found[r["doc_id"]]["score"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    bad, good = [s for t, s in tested if t], [s for t, s in tested if not t]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    # One in fourteen toxic texts of this table lost its insult with its short words, so nothing can tell it.
    assert above > 0.9
    assert sum(s >= toxic.THRESHOLD for s in bad) > 0.85 * len(bad) and sum(s < toxic.THRESHOLD for s in good) > 0.94 * len(good)


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    rows = [(i, text) for i, (_, text) in enumerate(sentences(3, 200))]
    said = [(i, label, 0, "x") for i, (label, _) in enumerate(sentences(3, 200))]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, q, h) for i, t, q, h in said]
    one, other = (sorted(map(tuple, toxic.toxicity(documents(rows), spark.createDataFrame(x, LABELS)).collect())) for x in (said, turned))
    assert one == other


def test_odd_texts(spark, documents, odd, nothing):
    rows = sentences(4, 80)
    said = spark.createDataFrame([(i, t, 0, "x") for i, (t, _) in enumerate(rows)] + [(None, 1, 1, "x"), (3, None, 0, "x"), (4, 1, 0, "x"), (4, 0, 0, "x")], LABELS)
    model = toxic.fit_documents(documents([(i, text) for i, (_, text) in enumerate(rows)]), said, ~toxic.held_out(toxic.F.col("doc_id")))
    got = toxic.score_texts(odd, model).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["worst_unit"] is None]
    assert len(empty) == 3 and len(set(empty)) == 1 and empty[0] < toxic.THRESHOLD
    assert toxic.toxicity(nothing, said).collect() == []
    none = toxic.toxicity(odd, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 9 and {r["predicted"] for r in none} == {0}
