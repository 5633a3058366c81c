"""Name text: normal forms, spelling variants, token cleaning and the candidate score."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from structaudit.functions.binding import let

# The vocabulary of the candidate score and of the normal forms.
STOPWORDS = """
the and for with from this that what how why structure molecule chemistry figure table slide
example result method data test demo team next step title name names iupac formula molecular
weight mass reference references page chapter lecture department
""".split()
NOISE = """
mw mol mmol nm um mg kg ml ppm ph kda da min hr eq wt vol fig ref et al pp nmr ir uv vis hplc gc
ms tlc dna rna cox sar qsar api pdf ppt abs obs calc coa
""".split()
BARE = "acid acids ester ether salt base ion group".split()
SUFFIXES = "ol al one ane ene yne ine ide ate ite amine amide ose yl oxide phenol ether ester".split()
VITAMINS = "vitamin vitamins".split()
FRAGMENTS = """
hydroxy methyl ethyl acetyl amino nitro chloro bromo fluoro benzo phenyl carboxy sulfo keto
""".split()
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ω": "omega", "μ": "mu"}
GREEK_HANGUL = {"α": "알파", "β": "베타", "γ": "감마", "δ": "델타", "ω": "오메가"}
ABBREVIATIONS = {"acn": "acetonitrile", "dcm": "dichloromethane"}
PARTICLES = """
이라는 라는 으로 에서 에게 부터 까지 보다 처럼 이나 이란 란 은 는 이 가 을 를 의 에 와 과 도 로 만 나
""".split()
DASHES = "‐‑‒–—−"
TRIMMED = ".,;:!?'”’·\""

LOCANT = r"\b[0-9]+(?:,[0-9]+)*-"
FORMULA_WORD = "^(?:[A-Z][a-z]?[0-9]{0,3})+$"
STEREO = r"(?:\([0-9]*[RSEZ](?:,[0-9]*[RSEZ])*\)|cis|trans|[DLRSEZ]|alpha|beta|gamma|delta|omega|[onmp])-"
STEREO_PREFIXES = r"^(?:(?:\([0-9RSEZrsez,+\-±/ ]+\)|cis|trans|rac|meso|[DLRSEZ])-)+"
TOKEN = r"[A-Za-z0-9(\[α-ω][A-Za-z0-9\-,'()\[\]+α-ω]*"
HANGUL = "[가-힣]"
# Unicode word boundaries: a particle glued to the letter means the letter is not a vitamin.
VITAMIN_IN_LINE = r"(?U)(?:vitamins?|비타민)\s*([A-Ka-k]\d{0,2})\b"
# On a line without brackets and Greek letters a cleaned token is a token that ends in neither a
# comma nor a quote, has two characters and a letter.
SPECIAL = r"[()\[\]α-ω]"
# Letters alone are told first, without going back.
PLAIN_TOKEN = r"[A-Za-z]{2,}+(?![,']*[A-Za-z0-9\-+])|(?=[0-9\-,'+]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9\-,'+]*[A-Za-z0-9\-+]"
SIMPLE_WORD = "^[A-Z]?[a-z]+$"
# Words of two small letters and more that end neither in a suffix nor in acid: by the last letter where it tells,
# else with one test for all endings of a length.
_ENDINGS = [*SUFFIXES, "acid"]
NO_SUFFIX = r"^[a-z]{2,}+(?:(?<![" + "".join(sorted({e[-1] for e in _ENDINGS})) + "])|" + "".join(
    f"(?<!{'|'.join(e for e in _ENDINGS if len(e) == n)})" for n in sorted({len(e) for e in _ENDINGS})
) + r")\z"
VITAMIN_HANGUL = r"^비타민\s*([A-Ka-k][0-9]{0,2})$"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = r"[\s\p{Z}]+"

_ASCII = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x30, 0x3A)])
_FULLWIDTH = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), table.items(), text)


def split_lines(text: Column) -> Column:
    """Lines of a text, the last one empty after a final line break; most texts have line feeds only, which need no pattern."""
    other = reduce(lambda a, b: a | b, [text.contains(c) for c in OTHER_BREAKS])
    return F.split(text, F.when(other, LINE_BREAK).otherwise("\n"))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def greek_to_latin(text: Column) -> Column:
    return _replace_all(text, GREEK)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Full compatibility normalisation; Spark has no builtin for it."""
    return text.str.normalize("NFKC")


def normalize_exact(text: Column, full: bool = False) -> Column:
    """Case, outer blanks, full-width letters and dash variants do not matter.

    ``full`` adds complete compatibility normalisation at the price of an Arrow round trip;
    without it only full-width ASCII letters and digits and the wide blank are folded.
    """
    folded = nfkc(text) if full else F.translate(text, _FULLWIDTH, _ASCII)
    return F.lower(collapse_blanks(fold_dashes(folded)))


def normalize_loose(text: Column, full: bool = False) -> Column:
    return F.regexp_replace(normalize_exact(text, full), r"[\s\-]+", "")


def ko_key(text: Column) -> Column:
    """Alias-table key: spacing and hyphens do not matter, Greek letters are spelled in Hangul."""
    return F.lower(F.regexp_replace(_replace_all(text, GREEK_HANGUL), r"[\s\-\p{Z}]+", ""))


def match_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9가-힣]", "")


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def looks_like_latin_name(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z][A-Za-z0-9\-,'()\s]*$") & text.rlike("[A-Za-z]{3,}")


def is_formula(word: Column) -> Column:
    return word.rlike("[0-9]") & word.rlike(FORMULA_WORD)


def vitamin_name(text: Column) -> Column:
    """``vitamin X`` for a Hangul vitamin name, else NULL."""
    hit = F.regexp_extract(F.trim(text), VITAMIN_HANGUL, 1)
    return F.when(hit != "", F.concat(F.lit("vitamin "), F.upper(hit)))


def may_name_vitamin(line: Column) -> Column:
    return line.contains("vitamin") | line.contains("비타민")


def vitamin_hits(line: Column) -> Column:
    """All vitamins named in a line, English or Hangul."""
    letters = F.regexp_extract_all(line, F.lit(VITAMIN_IN_LINE), F.lit(1))
    return F.transform(letters, lambda x: F.concat(F.lit("vitamin "), F.upper(x)))


def strip_stereo_prefix(text: Column) -> Column:
    return F.regexp_replace(text, STEREO_PREFIXES, "")


def expand_abbreviation(text: Column) -> Column:
    """Long form of the few unambiguous abbreviations, else NULL."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(text)))


def _first_of_each(values: Column) -> Column:
    """Drop blanks, and what an earlier entry already says in another case."""
    kept = F.filter(values, lambda v: v != "")
    lowered = F.transform(kept, F.lower)
    return F.filter(kept, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def strip(value: Column) -> Column:
    """The text without white space of any kind at its ends; a text that has none there is not searched for it."""
    ends = F.concat(F.left(value, F.lit(1)), F.right(value, F.lit(1)))
    # White space before a last \x85 goes too: the pattern takes that for the end of a line.
    return F.when(ends.rlike(r"[\s\p{Z}\x{85}]"), F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(value)


def spelling_variants(name: Column) -> Column:
    """Spellings to try in order, each saying a little less than the one before.

    A name of ASCII words one blank apart has no other spelling, unless it is an abbreviation or begins with a stereo prefix.
    """
    other = F.lower(name).isin(list(ABBREVIATIONS)) | name.rlike(STEREO_PREFIXES)
    return F.when(name.rlike(r"^[!-~]++(?: [!-~]++)*+\z") & ~other, F.array(name)).otherwise(_spellings(name))


def _spellings(name: Column) -> Column:
    plain = greek_to_latin(fold_dashes(name))
    stripped = strip_stereo_prefix(strip(plain))
    tried = F.array(
        name, plain, expand_abbreviation(plain), F.when(stripped != strip(plain), stripped)
    )
    return _first_of_each(F.transform(F.array_compact(tried), collapse_blanks))


def full_width(text: Column) -> Column:
    return F.translate(text, _ASCII, _FULLWIDTH)


def korean_key_variants(alias: Column) -> Column:
    """Spellings under which a Hangul alias is stored, so that a plain lookup finds it."""
    compact = F.regexp_replace(alias, r"[\s\-]+", "")
    trailing = rf"^(.*{HANGUL})([A-Za-z0-9]+)$"
    spaced = F.when(compact.rlike(trailing), F.regexp_replace(compact, trailing, "$1 $2"))
    bases = F.array_compact(F.array(alias, compact, spaced))
    wide = F.transform(F.filter(bases, lambda b: b.rlike("[A-Za-z0-9]")), full_width)
    return F.array_distinct(F.concat(bases, wide))


# Tokens ------------------------------------------------------------------------------------


def clean_token(token: Column) -> Column:
    """Token without loose punctuation and unpaired brackets; NULL when nothing name-like is left.

    A pair of brackets around the whole token is peeled only while the inside stays balanced;
    then unpaired closing, then unpaired opening brackets go.
    """

    def count(text: Column, char: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, char, F.lit("")))

    def trimmed(text: Column) -> Column:
        return F.btrim(text, F.lit(TRIMMED))

    def partner(bracket: Column) -> Column:
        return F.translate(bracket, "()[]", ")(][")

    def repeat(text: Column, step: Callable[[Column], Column]) -> Column:
        steps = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
        return F.aggregate(steps, text, lambda t, _: step(t))

    def unwrap(text: Column) -> Column:
        first, last = F.left(text, F.lit(1)), F.right(text, F.lit(1))
        inner = F.substr(text, F.lit(2), F.length(text) - 2)
        wrapped = (F.length(text) > 2) & first.isin("(", "[") & (last == partner(first))
        return F.when(wrapped & (count(inner, first) == count(inner, last)), trimmed(inner)).otherwise(text)

    def drop_last(text: Column) -> Column:
        last = F.right(text, F.lit(1))
        loose = last.isin(")", "]") & (count(text, partner(last)) < count(text, last))
        return F.when(loose, trimmed(F.left(text, F.length(text) - 1))).otherwise(text)

    def drop_first(text: Column) -> Column:
        first = F.left(text, F.lit(1))
        loose = first.isin("(", "[") & (count(text, partner(first)) < count(text, first))
        return F.when(loose, trimmed(F.substr(text, F.lit(2)))).otherwise(text)

    def peel(text: Column) -> Column:
        return let(repeat(text, unwrap), lambda t: let(repeat(t, drop_last), lambda u: repeat(u, drop_first)))

    def spell(text: Column) -> Column:
        return F.when(text.rlike("[α-ωμ]"), greek_to_latin(text)).otherwise(text)

    def without_brackets(text: Column) -> Column:
        return F.when(text.rlike(r"^[(\[]|[)\]]$"), peel(text)).otherwise(text)

    def checked(text: Column) -> Column:
        return F.when((F.length(text) >= 2) & text.rlike("[A-Za-zα-ω]"), text)

    return let(spell(trimmed(token)), lambda plain: let(without_brackets(plain), checked))


def clean_tokens(line: Column) -> Column:
    """Cleaned tokens of a line in order; most lines need no cleaning token by token."""
    cleaned = F.array_compact(F.transform(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), clean_token))
    plain = F.regexp_extract_all(line, F.lit(PLAIN_TOKEN), F.lit(0))
    return F.when(line.rlike(SPECIAL), cleaned).otherwise(plain)


# What one word contributes to the score of a phrase, as bits.
BAD, SUFFIX, STEREO_BIT, LOCANT_BIT, FRAGMENT, BARE_BIT, CAPITAL, ABBREVIATION, VITAMIN, VITAMIN_LETTER = (
    1 << i for i in range(10)
)
# Bits that give a phrase a score wherever they stand, and those that do so at its first word.
SCORES = SUFFIX | STEREO_BIT | LOCANT_BIT | FRAGMENT
OPENS = SCORES | CAPITAL | ABBREVIATION | VITAMIN


def is_bad_word(word: Column) -> Column:
    """Words that disqualify every phrase they occur in."""
    return (
        F.lower(word).isin(STOPWORDS + NOISE) | word.rlike("^[.,]*[0-9][.,0-9]*$") | is_formula(word)
    )


def _ends_in_suffix(low: Column) -> Column:
    """Suffix test without a regular expression, for words of plain letters."""
    sizes = sorted({len(s) for s in SUFFIXES})
    tests = [F.substring(low, -n, n).isin([s for s in SUFFIXES if len(s) == n]) for n in sizes]
    return reduce(lambda a, b: a | b, tests, low == "acid")


def may_hold_fragment(line: Column) -> Column:
    """False for a line none of whose cleaned tokens of small letters holds a fragment."""
    # A cleaned token is a part of its line, but for Greek letters, which are spelled out.
    return reduce(lambda a, b: a | b, [line.contains(f) for f in FRAGMENTS], line.rlike(SPECIAL))


def word_flags(word: Column) -> Column:
    """The bits of one word."""
    return word_flags_in_line(word, word.rlike("|".join(FRAGMENTS)))


def word_flags_in_line(word: Column, fragment: Column) -> Column:
    """:func:`word_flags` of a word on a line whose :func:`may_hold_fragment` is known.

    Ordinary prose dominates, so the tests are ordered by what they can skip: most words carry no bit and
    are told by their letters alone, a disqualified word needs no other bit, and a word of plain letters
    cannot carry digits or hyphens.
    """
    ordinary = word.rlike(NO_SUFFIX) & ~word.isin(STOPWORDS + NOISE + BARE + VITAMINS)
    return F.when(ordinary & ~fragment, 0).otherwise(_graded_flags(word))


def _graded_flags(word: Column) -> Column:
    def bits(tests: dict[int, Column]) -> Column:
        return reduce(lambda acc, kv: acc + F.when(kv[1], kv[0]).otherwise(0), tests.items(), F.lit(0))

    def graded(low: Column) -> Column:
        shared = {
            FRAGMENT: low.rlike("|".join(FRAGMENTS)),
            BARE_BIT: low.isin(BARE),
            VITAMIN: low.isin(VITAMINS),
        }
        simple = {
            **shared,
            SUFFIX: _ends_in_suffix(low),
            CAPITAL: (F.length(word) >= 5) & (word < "a"),
            VITAMIN_LETTER: (F.length(word) == 1) & (low <= "k"),
        }
        full = {
            **shared,
            SUFFIX: F.btrim(low, F.lit("()[]")).rlike(f"(?i)(?:{'|'.join(SUFFIXES)})$|^(?:{STEREO})?acid$"),
            STEREO_BIT: word.rlike(f"(?i)^{STEREO}"),
            LOCANT_BIT: low.rlike(LOCANT),
            CAPITAL: (F.length(word) >= 5) & word.rlike("^[A-Z]") & ~word.contains("-"),
            ABBREVIATION: word.rlike("^[A-Za-z]{2,6}$") & word.rlike("[A-Z].*[A-Z]"),
            VITAMIN_LETTER: low.rlike("^[a-k][0-9]{0,2}$"),
        }
        return (
            F.when(low.isin(STOPWORDS + NOISE), BAD)
            .when(word.rlike(SIMPLE_WORD), bits(simple))
            .when(is_bad_word(word), BAD)
            .otherwise(bits(full))
        )

    return let(F.lower(word), graded)


def flags_score(flags: list[Column]) -> Column:
    """Score of a phrase from its words' flags; NULL when it is no candidate."""
    n = len(flags)
    any_of = reduce(lambda a, b: a.bitwiseOR(b), flags)
    first, last = flags[0], flags[-1]

    def bonus(value: Column, bit: int, points: float) -> Column:
        """Points for a bit, as a product: exact, as bits are powers of two, and little code."""
        return value.bitwiseAND(bit) * (points / bit)

    value = (
        bonus(last, SUFFIX, 3.0)
        + bonus(first.bitwiseOR(last), STEREO_BIT, 2.0)
        + bonus(any_of, LOCANT_BIT, 2.0)
        + bonus(any_of, FRAGMENT, 2.0)
    )
    disqualified = any_of.bitwiseAND(BAD) > 0
    if n == 1:
        value = value + bonus(first, CAPITAL, 1.0) + bonus(first, ABBREVIATION, 0.5)
        disqualified = disqualified | (first.bitwiseAND(BARE_BIT) > 0)
    score = F.when(value > 0, value + min(n, 4) * 0.5)
    if n == 2:
        vitamin = (first.bitwiseAND(VITAMIN) > 0) & (last.bitwiseAND(VITAMIN_LETTER) > 0)
        score = F.when(vitamin, 4.0).otherwise(score)
    return F.when(~disqualified, score)


def candidate_score(phrase: Column) -> Column:
    """Score of a phrase given as text, of any number of words: how likely it is a name, -1 when it is none."""

    def has(value: Column, bit: int) -> Column:
        return value.bitwiseAND(bit) > 0

    def scored(flags: Column) -> Column:
        n, first, last = F.size(flags), F.get(flags, F.lit(0)), F.element_at(flags, -1)

        def from_all(any_of: Column) -> Column:
            bonus = lambda test, points: F.when(test, points).otherwise(0.0)
            value = (
                bonus(has(last, SUFFIX), 3.0) + bonus(has(first.bitwiseOR(last), STEREO_BIT), 2.0)
                + bonus(has(any_of, LOCANT_BIT), 2.0) + bonus(has(any_of, FRAGMENT), 2.0)
                + bonus((n == 1) & has(first, CAPITAL), 1.0) + bonus((n == 1) & has(first, ABBREVIATION), 0.5)
            )
            disqualified = has(any_of, BAD) | ((n == 1) & has(first, BARE_BIT))
            vitamin = (n == 2) & has(first, VITAMIN) & has(last, VITAMIN_LETTER)
            whole = let(value, lambda v: F.when(v > 0, v + F.least(n, F.lit(4)) * 0.5).otherwise(-1.0))
            return F.when(disqualified, -1.0).when(vitamin, 4.0).otherwise(whole)

        return let(F.aggregate(flags, F.lit(0), lambda a, b: a.bitwiseOR(b)), from_all)

    words = F.filter(F.split(collapse_blanks(phrase), " "), lambda w: w != "")
    some = let(F.transform(words, word_flags), lambda flags: F.when(F.size(flags) > 0, scored(flags)))
    return F.coalesce(some, F.lit(-1.0))


def is_noise(phrase: Column) -> Column:
    words = F.split(collapse_blanks(phrase), " ")
    bare = (F.size(words) == 1) & F.lower(F.get(words, F.lit(0))).isin(BARE)
    return F.exists(words, is_bad_word) | bare
