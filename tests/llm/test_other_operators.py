"""Vectors, captures, components and the pipeline."""

import collections
import datetime
import random

import numpy as np

import corpus_pipeline
from structaudit.llm import bpe, decontam, embed, langid, pii, simhash, warc
from structaudit.llm.components import components
from structaudit.llm.queries import word_vocabulary


def brute(vectors):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    links = {i: {j for j in unit if j != i and float(unit[i] @ unit[j]) >= 0.95} for i in unit}
    label = {}
    for i in sorted(unit):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += links[j]
    return links, label


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    vectors = {i: (centres[i % 40] + rng.standard_normal(16) * (0.02 + i % 7 * 0.05)).tolist() for i in range(400)}
    vectors |= {1000 + i: vectors[0] for i in range(30)}
    links, label = brute(vectors)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors.items()], "vec_id bigint, embedding array<double>, class int, cell string")
    for block in (embed.BLOCK, 8):
        monkeypatch.setattr(embed, "BLOCK", block)
        got = {r["vec_id"]: r for r in embed.embedding_groups(df).collect()}
        assert all(got[i]["n_links"] <= len(links[i]) for i in vectors)
        assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(map(len, links.values()))
        assert sum(got[i]["component_id"] == label[i] for i in vectors) >= 0.95 * len(vectors)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_pairs_just_above_the_threshold_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    left, other = (embed._unit(rng.standard_normal((2_000, 64))) for _ in range(2))
    other = embed._unit(other - (other * left).sum(axis=1, keepdims=True) * left)
    cosine = rng.uniform(0.9501, 0.96, (2_000, 1))
    both = np.concatenate([left, cosine * left + np.sqrt(1 - cosine**2) * other])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id bigint, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embed.embedding_groups(df).collect()}
    assert all(found[i] == found[i + 2_000] <= 1 for i in range(2_000))
    assert sum(found[i] for i in range(2_000)) >= 0.985 * 2_000


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]),
            (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (11, [1e-200, 2e-200]), (12, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(set)
    for r in embed.embedding_groups(df).collect():
        got[r["vec_id"]].add(tuple(r)[1:])
    assert all(got[i] == {(0, i, True)} for i in (1, 2, 3, 4, 5, 6, 10, 12)) and got[None] == {(0, None, False)}
    assert got[7] == {(3, 7, True)} and got[8] == got[9] == got[11] == {(3, 7, False)}
    assert embed.embedding_groups(df.limit(0)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_revisits_take_the_latest_earlier_response(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    rows = [
        (1, "response", "http://A.example:80/x#f", day(1), {"ETag": '"1"', "Server": "s", "Vary": "old"}), (2, "response", "http://a.example/x", day(3), {"etag": '"2"', "Server": "t"}),
        (3, "revisit", "http://a.example/x?utm_source=q", day(2), {"ETag": 'W/"1"', "Vary": "new", "Server": "u"}), (4, "revisit", "http://a.example/x", day(3, 5), {"ETag": '"1"'}),
        (5, "revisit", "http://a.example/x", day(9), {}), (6, "revisit", "http://a.example/x", day(1), {"ETag": '"1"'}), (7, "revisit", None, day(9), {}),
        (8, "revisit", "http://a.example/x", None, None), (9, "revisit", "http://b.example", day(2), {"Last-Modified": "m"}), (10, "response", "http://b.example/", day(1), {"Last-Modified": "m", "ETag": '"z"'}),
        (11, "request", "http://a.example/x", day(1), {}), (12, "response", "http://a.example/x", day(3), {"ETag": '"3"'}), (5, "revisit", "http://a.example/x", day(9), {}),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "record_id int, kind string, url string, captured timestamp, headers map<string,string>, base string")
    got = {r["revisit_id"]: (r["base_id"], r["status"], r["headers"]) for r in warc.resolved(df).collect()}
    assert warc.resolved(df).count() == 8
    assert got[3] == (1, "resolved", {"etag": 'W/"1"', "vary": "new", "server": "s"}) and got[4] == (12, "mismatch", None)
    assert got[5] == (12, "unchecked", {"etag": '"3"'}) and got[6] == got[7] == got[8] == (None, "no_base", None)
    assert got[9] == (10, "resolved", {"last-modified": "m", "etag": '"z"'})
    assert warc.resolved(df.limit(0)).count() == 0


def test_revisits_in_any_slicing(spark, sf, monkeypatch):
    records = warc.captures_of(spark.read.parquet(f"{sf}/pages.parquet"))
    rows = [r.asDict() for r in records.collect()]
    want = {}
    url = {r["record_id"]: r["u"] for r in records.select("record_id", warc.canonical_url(records["url"]).alias("u")).collect()}
    for r in rows:
        if r["kind"] == "revisit":
            before = [b for b in rows if b["kind"] == "response" and url[b["record_id"]] == url[r["record_id"]] and b["captured"] < r["captured"]]
            want[r["record_id"]] = max(before, key=lambda b: (b["captured"], b["record_id"]))["record_id"] if before else None
    for seconds in (86_400, 10**9, 60):
        monkeypatch.setattr(warc, "SLICE_SECONDS", seconds)
        assert {r["revisit_id"]: r["base_id"] for r in warc.resolved(records).collect()} == want


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "encoding"]
    good = {r["doc_id"] for r in langid.identify(docs, langid.fit(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    one = docs.where(docs.doc_id.isin(sorted(good)))
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(one).collect()}
    single = {i for i in good if groups[i] == i}
    two = docs.where(docs.doc_id.isin(sorted(single)))
    clean = single - {r["doc_id"] for r in decontam.contaminated_documents(two, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean and len(clean) > 0.5 * len(rows)
    coder = bpe.WordBpe(word_vocabulary())
    new = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(got[i] == coder.encode([new[i]])[0] for i in clean)


def test_pipeline_stages_on_odd_rows(spark, sf, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
        out = stage(spark, odd, sf)
        assert out.count() <= 9 and (name == "encoding" or out.columns == odd.columns)
