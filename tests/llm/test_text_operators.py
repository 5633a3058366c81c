"""Operators on texts against brute force or the library whose results they must match."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from structaudit.llm import bpe, decontam, langid, pii, queries, repeats, secrets, shard, simhash

PATH = public_tokenizers.path("word_bpe_49k.json")


def sf_texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# --- decontamination


def swat(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(30):
        a = [rng.randint(1, 6) for _ in range(rng.randint(3, 20))]
        b = [[rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(4)]
        got = decontam.aligned(np.array(a), [np.array(x) for x in b])
        assert got.tolist() == [swat(a, [x or -1 for x in y]) for y in b]


def test_edited_copies_are_found(spark, documents, odd, nothing):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(40)]
    edited = [w for i, w in enumerate(item) if i % 9] + ["tail"]
    edited[7] = "changed"
    noise = lambda n: [word() for _ in range(n)]
    docs = documents([
        (1, " ".join(noise(50) + item + noise(50))), (2, " ".join(noise(30) + edited)), (3, " ".join(noise(300))),
        (4, " ".join(item[:8] + noise(90))), (5, None), (5, ""), (None, " ".join(item)), (6, " ".join(noise(20_000) + item)),
    ])
    items = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_documents(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7), (6, 7)} and got[1, 7] == 1.0 and 0.5 <= got[2, 7] < 1
    assert decontam.contaminated_documents(nothing, items).count() == 0
    assert decontam.contaminated_documents(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("whole_copies", [0, 1])
def test_copies_with_many_words_replaced_are_found(spark, documents, whole_copies):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    spaced = lambda gap: lambda j: j % gap == gap - 1
    drawn = lambda rate: lambda j: rng.random() < rate
    kinds = [spaced(gap) for gap in (5, 6, 7, 8)] + [drawn(rate) for rate in (0.1, 0.15, 0.2, 0.25, 0.3)]
    # Every item has one edited copy of its own, alone or beside an unedited one.
    items, texts, want = [], [], set()
    for i in range(90):
        item = [word() for _ in range(40)]
        copy = [word() if kinds[i % 9](j) else w for j, w in enumerate(item)]
        items.append((i, " ".join(item)))
        texts += [(i, " ".join([word(), *copy, word()])), *[(1000 + i, " ".join(item))] * whole_copies]
        want |= {(i, i)} if swat(item, copy) >= len(item) else set()
        want |= {(1000 + i, i)} if whole_copies else set()
    assert all((i, i) in want for i in range(90) if i % 9 < 4)
    df = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_documents(documents(texts), df).collect()} == want


def test_words_are_numbered_alike_wherever_they_stand():
    texts = ["Ünï_code 日本 😀 x1", None, "", "a b c ab ba aab aba baa abc cab 1 11 111", "İ. ΣΑΣ ß\ud800 naïve", "ab " * 400_000 + "cab"]
    numbers, counts = decontam.words_of(texts)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    named = {w: decontam.words_of([w])[0][0] for w in sorted({w for ws in words for w in ws})}
    assert numbers.tolist() == [named[w] for ws in words for w in ws] and len(set(named.values())) == len(named) and 0 not in named.values()


def test_all_alignments_are_found(spark, sf):
    """Against the alignment of every item with every whole text."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    known, want = lambda text: decontam.words_of([text])[0], {}
    texts = {r["doc_id"]: known(r["text"]) for r in docs.select("doc_id", "text").collect()}
    texts = {i: w for i, w in texts.items() if len(w)}
    for r in items.collect():
        item = known(r["text"])
        assert decontam.SHORTEST <= len(item) <= decontam.PIECE
        for i, score in zip(texts, decontam.aligned(item, list(texts.values())).tolist(), strict=True):
            if score >= len(item):
                want[i, r["item_id"]] = score / (2 * len(item))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated_documents(docs, items).collect()}
    assert got == pytest.approx(want)


def test_copies_without_three_words_in_a_row_are_found(spark, documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    edits = [
        lambda item: [x for i, w in enumerate(item) for x in ([w, word()] if i % 2 else [w])],
        lambda item: [x for w in item for x in (w, word())],
        lambda item: [word() if i % 3 == 2 else w for i, w in enumerate(item)],
        lambda item: [w for i, w in enumerate(item) if i % 3 != 2],
        lambda item: [x for w in item for x in rng.choice([[w], [w], [w, word()], [word()], []])],
    ]
    items, texts, want = [], [], set()
    for i in range(150):
        item = [word() for _ in range(rng.randint(8, 128))]
        copy = edits[i % 5](item)
        items.append((i, " ".join(item)))
        # Copies lie anywhere among the passages, beside whole ones that make their seeds common.
        texts += [(i, " ".join([*[word() for _ in range(rng.randint(0, 900))], *copy, word()])), *[(1000 + i, " ".join(item))] * 3]
        want |= {(i, i)} if swat(item, copy) >= len(item) else set()
        want |= {(1000 + i, i)}
    assert sum(i < 1000 for i, _ in want) > 90
    df = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_documents(documents(texts), df).collect()} == want


def test_short_and_long_items(spark, documents):
    long = " ".join(f"w{i}" for i in range(5000))
    items = [(1, "Yes"), (2, "so be"), (3, "one two three"), (4, "a b c d e f g"), (5, long), (6, "x x x x x x x x x"), (7, "?!")]
    texts = [
        (1, "yes."), (2, "yes they do"), (3, "so be it"), (4, "So be"), (5, "and one two three go"), (6, "one two or three"), (7, "z a b c d e f g z"),
        (8, "a b c d e f"), (9, "q " * 700 + " ".join(f"w{i}" for i in range(3000, 3140))), (10, "x " * 3000), (11, "?!"), (12, "x x y"),
        (13, "w" * 3_000_000 + " one two three"),
    ]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated_documents(documents(texts), df).collect()}
    assert got == {(1, 1), (4, 2), (5, 3), (7, 4), (9, 5), (10, 6), (13, 3)}


def test_items_with_a_stem_in_common(spark, documents):
    """The stem is common, so its places get no seeds, however often one text repeats it."""
    stem = "which of the following statements about this is true"
    items = [(i, f"{stem} " + " ".join(f"u{i}x{j}" for j in range(12))) for i in range(3000)]
    texts = [(1, f"{stem} " * 100), (2, f"{stem} " + " ".join(f"u7x{j}" for j in range(12)))]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.contaminated_documents(documents(texts), df)
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found.collect()] == [(2, 7, 1.0)]


# --- repeated strings


def removed(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield len(b), len(b) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


def repeat_rows():
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b = some(700), some(260)
    near = [a[:i] + "#" + a[i + 1 :] for i in range(100, 600, 7)]
    return [a, a, b + some(300), some(100) + b, "x" * 450, b[:199], None, "", "y" * 199 + b[:1], *near, "z" * 5_000]


@pytest.mark.parametrize("segments", [6_000, 2])
def test_repeats_against_brute_force(documents, monkeypatch, segments):
    monkeypatch.setattr(repeats, "SEGMENTS", segments)
    texts = repeat_rows()
    got = {r["doc_id"]: tuple(r)[1:5] for r in repeats.without_repeats(documents(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(removed(texts)))


def test_repeats_odd_rows(odd, nothing):
    assert repeats.without_repeats(odd).count() == 9
    assert repeats.without_repeats(nothing).count() == 0


def test_common_prefixes_by_expansion():
    rng = random.Random(9)
    text = np.array([rng.randint(1, 3) for _ in range(300)] + [0], np.uint16)
    order = repeats.suffixes(text, 400)
    s = text.tolist()
    assert [s[i:] for i in order] == sorted(s[i:] for i in range(len(s)))
    lcp = lambda a, b: next((k for k in range(301) if a[k : k + 1] != b[k : k + 1]), 301)
    want = [0] + [lcp(s[i:], s[j:]) for i, j in zip(order, order[1:], strict=False)]
    got = repeats.common_prefixes(text[order - 1], 6).tolist()
    # Beside a suffix that ends before the stop a border may stay open; no window starts there.
    whole = [i > 0 and max(order[i], order[i - 1]) + 6 <= 300 for i in range(len(order))]
    assert [g for g, ok in zip(got, whole, strict=True) if ok] == [w if w < 6 else -1 for w, ok in zip(want, whole, strict=True) if ok]


# --- sharding


def test_shards_follow_the_permutation(spark, documents, odd, nothing):
    docs = documents([(i * 3 % 101, f"text {i % 5}") for i in range(101)])
    rows = shard.feistel_shards(docs, shards=7, seed=5).collect()
    assert sorted(r["row_number"] for r in rows) == list(range(101))
    for r in rows:
        to = shard.permute(r["row_number"], 101, 5)
        assert (r["shard"], r["slot"]) == (to % 7, to // 7) and shard.row_at(r["shard"], r["slot"], 101, 5, 7) == r["row_number"]
        text = f"text {r['doc_id'] * 34 % 101 % 5}"
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text.encode())) and r["row_number"] == r["doc_id"]
    assert shard.feistel_shards(nothing).count() == 0
    strange = shard.feistel_shards(odd, shards=4).collect()
    sizes = collections.Counter(r["shard"] for r in strange)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in strange) == sorted((i % 4, i // 4) for i in range(9))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation_is_one(n):
    assert sorted(shard.permute(x, n, 12) for x in range(n)) == list(range(n))
    big = 10**12 + 7
    assert all(shard.row_at(t % 40, t // 40, big, 3, 40) == x for x in range(0, big, big // 50) for t in [shard.permute(x, big, 3)])


# --- BPE


def test_bpe_equals_the_library(spark, sf, documents, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    texts = [*sf_texts(spark, sf).values(), "", " ", "It's 12½ ² Ⅷ<|endoftext|>x <|ENDOFTEXT|>", "a\x00b c\x1cd\x1fe\x85f\xa0g​h﻿i", "ΑΣ İ K Å é 가 日本 😀", "w" * 3_000]
    rows = [*enumerate(texts), (None, "x"), (len(texts), None)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(rows), PATH, with_ids=True).collect()}
    for i, text in enumerate([*texts, ""]):
        ids = lib.encode(text, add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_documents(nothing, PATH).count() == 0


def test_bpe_round_trip_and_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    coder = bpe.WordBpe(PATH)
    for text in ["hello world again and again", "être naïve 日本 ok", "hello world"]:
        ids = coder.encode([text])[0]
        assert coder.text_of(ids).split() == text.split() and coder.decode(ids).count("</w>") == len(text.split())


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def test_pii_equals_plain_search(spark, sf, documents, odd, nothing):
    rng = random.Random(8)
    bits = ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "000255.0.0.1", "a.b@c.d", "b_@x@y.z.w", "a@b.c_d@e.f",
            "+1 (743) 555-3824", "+49 30 1", " ", "-", ".", "é😀", "9", "12", "@", "+", "x", "\n", "_", "4111-1111-1111-1111-"]
    texts = [*sf_texts(spark, sf).values(), *["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(1_500)], "a" * 200_000, "1" * 100_000, "1." * 50_000]
    rows = [*enumerate(texts), (-1, None), (None, "a@b.c"), (-2, "")]
    for r in pii.find_pii(documents(rows)).select("doc_id", "text", pii.span_list(pii.F.col("spans"), base_only=True).alias("s")).collect():
        assert r["s"] == ",".join(base_spans(r["text"])), r["text"][:200]
    assert pii.find_pii(nothing).count() == 0 and pii.find_pii(odd).count() == 9


def test_pii_added_kinds_need_proof(documents):
    rows = [(1, "pay to DE89370400440532013000 now"), (2, "pay to DE88370400440532013000 now"), (3, "iban GB82 WEST 1234 5698 7654 32."),
            (4, "her ssn is 123-45-6789"), (5, "part no 123-45-6789"), (6, "mail x@y.zz or +1 (743) 555-3824!"), (7, None)]
    got = {r["doc_id"]: r for r in pii.find_pii(documents(rows)).collect()}
    kinds = {i: [s["kind"] for s in r["spans"]] for i, r in got.items()}
    assert kinds == {1: ["iban"], 2: [], 3: ["iban"], 4: ["national"], 5: [], 6: ["email", "phone"], 7: []}
    red = {r["doc_id"]: r for r in pii.redact(documents(rows)).collect()}
    assert red[6]["text"] == "mail [EMAIL] or [PHONE]!" and red[6]["n_chars"] == len(red[6]["text"]) and red[7]["text"] is None
    assert red[6]["_text"] == "y" and pii.redact(documents(rows)).columns == documents(rows).columns


def test_redaction_covers_overlapping_spans(documents):
    texts = {
        "call +1 743 555 3824 9jane@mail.org now": "call [PHONE][EMAIL] now", "4111 1111 1111 1111@mail.org": "[CARD][EMAIL]",
        "é😀 mail a@b.org, ip 10.0.0.1": "é😀 mail [EMAIL], ip [IP]", "x +1 743 555 3824": "x [PHONE]", "none": "none",
        "+4111111111111111": "+[CARD]",
    }
    got = {r["doc_id"]: r["text"] for r in pii.redact(documents(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_very_many_hits_in_one_text(documents):
    rng = random.Random(11)
    bits = ["jane.doe@mail.org", "10.2.3.4", "4111 1111 1111 1111", "+1 743 555 3824", "plain words é😀", "\n", "9jane@mail.org"]
    long = " ".join(f"{rng.choice(bits)} {'x' * rng.randint(0, 60)}" for _ in range(40_000))
    rows = documents([(1, long), (2, "a@b.c " * 20_000)])
    began = time.monotonic()
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(rows).collect()}
    red = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert time.monotonic() - began < 60
    assert pii_list(found[1]) == base_spans(long) and len(found[2]) == 20_000
    parts, at = [], 0
    for s in found[1]:
        if s["end"] > at:
            parts += [long[at : max(at, s["start"])], f"[{s['kind'].upper()}]"]
            at = s["end"]
    assert red[1] == "".join([*parts, long[at:]]) and red[2] == "[EMAIL] " * 20_000


def pii_list(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in ("email", "ip", "card", "phone")]


# --- SimHash


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if label[a] != label[b] and linked(a, b):
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return label


def test_simhash_against_all_pairs(spark, sf, monkeypatch):
    texts = dict(list(sf_texts(spark, sf).items())[:150])
    base = list(texts.values())[:10]
    texts |= {10_000 + i * 10 + j: " ".join(base[i].split()[: -j or None]) for i in range(10) for j in range(6)} | {20_000: None, 20_001: ""}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(sorted(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for most in (simhash.BUCKET, 1):
        monkeypatch.setattr(simhash, "BUCKET", most)
        got = simhash.simhash_groups(docs).collect()
        assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fp
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_covering_misses_no_pair():
    first = simhash.masks(3, list(range(64)))
    rng = random.Random(1)
    for _ in range(3_000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(d & m == 0 for m in first)
        m = next(m for m in first if d & m == 0)
        assert any(d & x == 0 for x in simhash.masks(3, [p for p in range(64) if not m >> p & 1]))


def test_simhash_odd_rows(odd, nothing):
    got = collections.defaultdict(set)
    for r in simhash.simhash_groups(odd).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got[1] == got[2] == got[3] == {1} and got[4] == got[5] == {4} and got[None] == {None}
    assert simhash.simhash_groups(nothing).count() == 0


# --- language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs.drop("lang", "source"), langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(odd, nothing, documents):
    model = langid.fit(documents([(i, "the cat sat on it" if i % 2 else "der hund war nicht da") for i in range(60)], lang=lambda i, t: "en" if i % 2 else "de"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()]
    assert len(got) == 9 and {i for i, lang, _ in got if lang == "und"} == {1, 2, 3} and all(s == 0 for _, lang, s in got if lang == "und")
    assert langid.fit(odd) is None and {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(nothing, model).count() == 0


# --- secrets


def test_forest_removes_false_positives(documents, odd, nothing):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{key()}" and more words here') for i in range(40)]
    rows += [(100 + i, f"see https://host/{key()} for the words") for i in range(40)] + [(200 + i, f"words {rng.randint(10**17, 10**18)} words") for i in range(40)]
    got = secrets.scan_secrets(documents(rows)).collect()
    assert {r["doc_id"] for r in got if r["is_secret"]} == set(range(40)) and len(got) == 120
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in got)
    assert secrets.scan_secrets(nothing).count() == 0 and secrets.scan_secrets(odd).count() == 0


FORMS = [
    "API_KEY={}", "export AWS_SECRET_ACCESS_KEY={}", "run --token={} now", "api_key: {}", "S3_ARCHIVE_SECRET_V2_KEY={}", 'password = "{}"',
    "AUTH_TOKEN_V2_PRIMARY='{}'", "Authorization: Bearer {}", '{{"secret": "{}"}}',
]


def test_secrets_in_every_form_of_assignment(documents):
    rng = random.Random(12)
    key = lambda pad: "".join(rng.sample("0123456789", 4) + rng.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 18)) + pad
    keys = {i: key("==" if i % 20 < 10 else "") for i in range(180)}
    rows = [(i, f"some words\n{FORMS[i % 9].format(k)}\nmore words") for i, k in keys.items()]
    rows += [(1000 + i, f"see https://host/{key('')} for the words") for i in range(40)]
    got = secrets.scan_secrets(documents(rows)).collect()
    assert {(r["doc_id"], r["value"]) for r in got if r["is_secret"]} == set(keys.items())
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in got)


def test_training_draws_both_labels_alike_whatever_is_copied(spark, monkeypatch):
    monkeypatch.setattr(secrets, "TRAINING", 400)
    rows = [([float(i)], float(i % 2)) for i in range(1_000)] + [([1.0], 1.0)] * 20_000
    drawn, labels = secrets.training_rows(spark.createDataFrame(rows, "x array<double>, label double"))
    counts = collections.Counter(r["label"] for r in drawn.collect())
    assert labels == {0.0, 1.0} and all(140 <= counts[label] <= 260 for label in labels)


def test_forest_learns_given_labels(spark, documents):
    rows = [(i, f"a {'k9' * 10} b") for i in range(20)] + [(100 + i, f"a {'Zq' * 12}7 b") for i in range(20)]
    docs = documents(rows)
    marks = spark.createDataFrame([(i, 2, float(i < 100)) for i, _ in rows if i % 2], "doc_id bigint, start bigint, label double")
    got = secrets.scan_secrets(docs, marks).collect()
    assert {r["doc_id"] for r in got if r["is_secret"]} == set(range(20))


def test_queries_have_their_columns(spark, sf):
    assert set(queries.QUERIES) >= {"op1_decontamination", "op10_secrets"}
    assert queries.op4_feistel_shards(spark, sf).columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert queries.op2_bwt_repeats(spark, sf).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
