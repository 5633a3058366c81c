"""BPE with word ends, encoded by walking a trie of the distinct words.

A piece of text has exactly one encoding, and every prefix of that encoding's tokens encodes a
prefix of the text. So the encoding of a prefix is known from its last token alone: drop that
token and look at the prefix that is left. The trie holds each shared prefix once; a depth-first
walk hands the last-token states down, and every word reads its tokens off the states on its path.
A token may come last if it and the last token before it do not merge across their border.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from structaudit.llm.common import slices, text_rows

END = "</w>"
#: White space as the tokenizer's own pattern has it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Encodings kept in one Python worker, and bytes of text whose words form one trie.
CACHED, TRIE_BYTES = 100_000, 2_000_000
#: Token pairs whose border has been looked at, in one worker.
BORDERS = 200_000


def byte_letters() -> str:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printing else chr(next(others)) for b in range(256))


LETTERS = {b: c for b, c in enumerate(byte_letters())}
BYTES = {c: b for b, c in LETTERS.items()}


class WordBpe:
    """Encoder and decoder for one vocabulary file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.born = {a + b: i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (a, b) for a, b in pairs}
        if len(self.born) != len(pairs):
            raise ValueError("a token is made by two merges; its edges are then not known from the token")
        # A token with no merge of its own must be a single symbol; others never come up.
        usable = [t for t in self.vocab if t in self.halves or len(t.removesuffix(END)) == 1]
        self.ends = {t: self._made_of(t, 1) for t in usable}
        self.starts = {t: self._made_of(t, 0) for t in usable}
        self.beginnings = {t[:n] for t in (u.removesuffix(END) for u in usable) for n in range(1, len(t) + 1)}
        self.borders: dict[tuple[str, str], bool] = {}
        #: The file's normalizer and the first of its pre-tokenizers, which cuts words; the second only spells bytes.
        self.normalizer = Tokenizer.from_file(path).normalizer
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        self.splitter = pre_tokenizers.Split(Regex(first["pattern"]["Regex"]), first["behavior"].lower(), first["invert"])
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}

    def _made_of(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of ``token`` while it is built, smallest first.

        With each comes the rank of the merge that takes it away; the token itself stays.
        """
        chain, until = [], len(self.ranks)
        while token is not None:
            chain.append((token, until))
            until, token = self.born.get(token, -1), self.halves[token][side] if token in self.halves else None
        return chain[::-1]

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens, each its own encoding, do not merge across their border.

        Follow the symbols on both sides of the border in the order in which merges replace them.
        The border is crossed if the two that stand there have a rank that comes before both are
        replaced; of equal ranks the leftmost goes first.
        """
        key = (left, right)
        known = self.borders.get(key)
        if known is None:
            a, b, i, j, known = self.ends[left], self.starts[right], 0, 0, True
            while True:
                (x, gone_x), (y, gone_y) = a[i], b[j]
                rank = self.ranks.get((x, y))
                if rank is not None and rank < gone_x and rank <= gone_y:
                    known = False
                    break
                if gone_x <= gone_y:
                    i += 1
                else:
                    j += 1
                if i == len(a) or j == len(b):
                    break
            if len(self.borders) > BORDERS:
                self.borders.clear()
            self.borders[key] = known
        return known

    def _last(self, prefix: str, lasts: list[str], end: str, most: int) -> str:
        """Last token of ``prefix`` + ``end``, from the last tokens of all shorter prefixes."""
        n, ends = len(prefix), self.ends
        for size in range(most, 0, -1):
            token = prefix[n - size :] + end
            if token in ends and (size == n or self.apart(lasts[n - size], token)):
                return token
        raise ValueError(f"no token ends {prefix!r}")

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word (in byte letters)."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in word:
                node = node.setdefault(c, {})
            node[END] = word
        found: dict[str, list[str]] = {}
        # By depth: last token of the prefix, and the longest suffix that begins some token.
        lasts, reach = [""] * (max(map(len, words), default=0) + 1), [0] * (max(map(len, words), default=0) + 1)
        stack = [(child, c) for c, child in trie.items()]
        while stack:
            node, prefix = stack.pop()
            depth = len(prefix)
            most = reach[depth - 1] + 1
            while prefix[depth - most :] not in self.beginnings:
                most -= 1
            reach[depth] = most
            word = node.pop(END, None)
            if node:
                lasts[depth] = self._last(prefix, lasts, "", most)
                stack += [(child, prefix + c) for c, child in node.items()]
            if word is not None:
                token = self._last(prefix, lasts, END, most)
                tokens, at = [token], depth - len(token) + len(END)
                while at:
                    tokens.append(lasts[at])
                    at -= len(lasts[at])
                found[word] = tokens[::-1]
        return found

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens, in lower case.

        Python's Unicode tables are not the tokenizer's: a few code points are letters, or have a lower
        case, in one of them alone. Each code point is tried against the tokenizer's own steps when it
        is first met in a worker, and texts with one that differs are split by those steps.
        """
        if text.isascii():
            return WORDS.findall(text.lower())
        met = set(text)
        for c in met - self.alike:
            probe = f"a{c}a {c}{c} {c}1{c}"
            if c not in self.unlike:
                (self.alike if self._split(probe) == self._as_the_file_says(probe) else self.unlike).add(c)
        return self._split(text) if self.unlike.isdisjoint(met) else self._as_the_file_says(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        # Letters one by one: a final sigma is not told apart.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _as_the_file_says(self, text: str) -> list[str]:
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def parts(self, text: str) -> list[tuple[bool, list[str]]]:
        """The text's words, and its special tokens where they stand: (is special, words)."""
        if self.cut is None or "<|" not in text:
            return [(False, self.split(text))]
        pieces = self.cut.split(text)
        return [(bool(i % 2), [p] if i % 2 else self.split(p)) for i, p in enumerate(pieces)]

    def learn(self, words: set[str]) -> None:
        """Have all of ``words`` encoded; the new ones over one trie. Words not met lately are forgotten."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        words = words - self.known.keys()
        again = words & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        words -= again
        spelled = {
            w: w if w.isascii() and w.isprintable() else w.encode("utf-8", "replace").decode("latin-1").translate(LETTERS)
            for w in words
        }
        encoded = self.encode_words(set(spelled.values()))
        for word, letters in spelled.items():
            tokens = encoded[letters]
            self.known[word] = (" ".join([str(self.vocab[t]) for t in tokens]), " ".join(tokens), len(tokens))

    def forget(self) -> None:
        """Drop the words and borders met so far."""
        self.known, self.older, self.borders = {}, {}, {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [[int(i) for i in ids.split()] for ids, _, _ in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each text: its ids and its tokens, each joined by blanks, and their number."""
        cut = [self.parts(t) for t in texts]
        words: set[str] = set()
        for parts in cut:
            for special, found in parts:
                if not special:
                    words.update(found)
        self.learn(words)
        named = {s: (str(i), s, 1) for s, i in self.special.items()}
        out = []
        for parts in cut:
            held = [h for special, found in parts for h in map((named if special else self.known).__getitem__, found)]
            ids, tokens, counts = zip(*held, strict=True) if held else ((), (), ())
            out.append((" ".join(ids), " ".join(tokens), sum(counts)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the file names no decoder, so word ends stay visible."""
        return " ".join(self.tokens[i] for i in ids)

    def text_of(self, ids: list[int]) -> str:
        """Words as they were before encoding, with a blank after each."""
        letters = "".join(self.tokens[i] for i in ids).replace(END, " ")
        return bytes(b for c in letters for b in ([32] if c == " " else [BYTES[c]])).decode("utf-8", "replace")


@functools.lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    """One per Python worker and file."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array).

    ``path`` names a vocabulary file that every machine has. A null text is an empty one: no tokens.
    Special tokens in a text become their ids. Repeated rows are answered one by one, extra columns
    are ignored, an empty table gives no rows. Text goes through in runs of about two megabytes, whose
    new words share a trie; a long document is one run by itself.
    """

    def run(batches):
        bpe = tokenizer(path)
        gc.disable()  # nothing made here is cyclic, and looking for cycles costs a third of the time
        try:
            for batch in batches:
                texts = batch.column(1).fill_null("")
                for start, end in slices(pa.compute.binary_length(texts).to_pylist(), TRIE_BYTES):
                    rows = bpe.encoded(texts.slice(start, end - start).to_pylist())
                    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                    columns = [
                        batch.column(0).slice(start, end - start), pa.array([n for _, _, n in rows], pa.int64()),
                        pa.array([digest(ids) for ids, _, _ in rows]), pa.array([digest(out) for _, out, _ in rows]),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        held = [np.array(ids.split(), dtype=np.int32) for ids, _, _ in rows]
                        bounds = np.cumsum([0, *map(len, held)], dtype=np.int32)
                        columns.append(pa.ListArray.from_arrays(bounds, np.concatenate(held)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            # The worker may go on to other work: it keeps the vocabulary, not the words.
            bpe.forget()
            gc.enable()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return text_rows(docs).mapInArrow(run, schema)
