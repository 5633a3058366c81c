"""Every code point is cut and encoded as the tokenizers library does it."""

import pytest
from tokenizers import Tokenizer

from structaudit.llm import bpe
from structaudit.llm.queries import word_vocabulary


@pytest.mark.parametrize("block", range(4))
def test_every_code_point(block):
    bounds = [0, 0x8000, 0x10000, 0x20000, 0x30000]
    points = [c for c in map(chr, range(bounds[block], bounds[block + 1])) if not "\ud800" <= c <= "\udfff"]
    texts = [f"a{c}b {c} Ü{c}{c}9" for c in points]
    library, own = Tokenizer.from_file(word_vocabulary()), bpe.WordBpe(word_vocabulary())
    library.no_truncation()
    library.no_padding()
    wrong = []
    for at in range(0, len(texts), 4096):
        some = texts[at : at + 4096]
        for text, mine, theirs in zip(some, own.encode(some), library.encode_batch(some, add_special_tokens=False)):
            if mine != theirs.ids:
                wrong.append((text, mine, theirs.ids))
    assert not wrong, (len(wrong), wrong[:5])
    assert own.unlike or block == 3


def test_a_strange_letter_changes_the_way_not_the_words():
    library, own = Tokenizer.from_file(word_vocabulary()), bpe.WordBpe(word_vocabulary())
    plain = "The ΣΑΣ straße İstanbul ñandú 42nd  it's  <|endoftext|> été"
    for odd in ("", "՘", "Ᲊ", "Ɤ", "\U00010940"):
        text = plain + odd + plain
        assert own.encode([text])[0] == library.encode(text, add_special_tokens=False).ids
