"""Element counts read off structure strings and formulas, without a chemistry library.

Counting is lexical. A parser would also refuse fragments with broken valences and compare
fragments in canonical form; here two fragments are the same when their text is, and only an
empty string or unbalanced brackets make a fragment uncountable (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from structaudit.functions.binding import let

# When one fragment counts as the principal one, and when a reading is nonsense.
MIN_PRINCIPAL_ATOMS = 6
PRINCIPAL_RATIO = 2
NONSENSE_ATOM_RATIO = 3.0
NONSENSE_ATOM_FLOOR = 40
MAX_FRAGMENTS = 3

# An atom is a bracket atom, a two-letter halogen, or a one-letter atom (lower case: aromatic).
AROMATIC = "bcnops"
ATOM = r"\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*"
BRACKET_SYMBOL = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)"
FORMULA_PART = "([A-Z][a-z]?)([0-9]*)"


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def atom_symbols(fragment: Column) -> Column:
    """Element symbols of all written atoms, in order; NULL when the string cannot be counted."""

    def symbol(token: Column) -> Column:
        bare = F.when(token.startswith("["), F.regexp_extract(token, BRACKET_SYMBOL, 1)).otherwise(token)
        return let(bare, lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.substring(b, 2, 2)))

    def from_tokens(tokens: Column) -> Column:
        # Without bracket atoms only aromatic letters change, and they stand alone.
        plain = F.split(F.translate(F.array_join(tokens, ","), AROMATIC, AROMATIC.upper()), ",")
        symbols = F.when(fragment.contains("["), F.transform(tokens, symbol)).otherwise(plain)
        return F.when(F.size(tokens) > 0, symbols)

    balanced = (_count(fragment, "[") == _count(fragment, "]")) & (_count(fragment, "(") == _count(fragment, ")"))
    return F.when(balanced, let(F.regexp_extract_all(fragment, F.lit(f"({ATOM})"), F.lit(1)), from_tokens))


def fragments(smiles: Column) -> Column:
    return F.split(smiles, r"\.")


def principal_fragment(smiles: Column) -> Column:
    """The main component of a salt or solvate, or the string itself when none stands out.

    A string with a fragment that cannot be counted stays whole.
    """

    def choose(text: Column) -> Column:
        sized = F.transform(
            F.array_distinct(fragments(text)),
            lambda p: F.struct(p.alias("text"), F.array_size(F.array_remove(atom_symbols(p), "H")).alias("n")),
        )

        def largest(parts: Column) -> Column:
            by_size = F.array_sort(parts, lambda a, b: b["n"] - a["n"])
            first, second = F.get(by_size, F.lit(0)), F.get(by_size, F.lit(1))
            stands_out = (first["n"] >= MIN_PRINCIPAL_ATOMS) & (first["n"] >= PRINCIPAL_RATIO * second["n"])
            return (
                F.when(F.exists(parts, lambda p: p["n"].isNull()), text)
                .when(F.size(parts) == 1, first["text"])
                .when(stands_out, first["text"])
                .otherwise(text)
            )

        return let(sized, largest)

    return F.when(smiles.contains("."), let(smiles, choose)).otherwise(smiles)


def _formula_text(symbols: Column) -> Column:
    """Carbon first, then alphabetical; a count of one is not written."""

    def write(atoms: Column) -> Column:
        def counted(text: Column) -> Column:
            def part(kind: Column) -> Column:
                # Every atom of the kind is two marks and its letters; taken out, they tell how many there were.
                gone = F.length(text) - F.length(F.replace(text, F.concat(F.lit("<"), kind, F.lit(">")), F.lit("")))
                return let(
                    (gone / (F.length(kind) + 2)).cast("int"),
                    lambda n: F.concat(kind, F.when(n > 1, n.cast("string")).otherwise("")),
                )

            return let(
                F.array_sort(F.array_distinct(atoms)),
                lambda kinds: F.array_join(
                    F.transform(F.concat(F.array_intersect(F.array(F.lit("C")), kinds), F.array_remove(kinds, "C")), part), ""
                ),
            )

        return let(F.concat(F.lit("<"), F.array_join(atoms, "><"), F.lit(">")), counted)

    return let(symbols, write)


def heavy_atom_formula(smiles: Column) -> Column:
    """Composition of the principal fragment, without implied hydrogens."""
    return _formula_text(let(principal_fragment(F.trim(smiles)), atom_symbols))


def largest_fragment_formula(smiles: Column) -> Column:
    """Composition of the largest fragment, whatever the others are."""

    def longest(lists: Column) -> Column:
        most = F.array_max(F.transform(lists, F.size))
        return F.get(F.filter(lists, lambda s: F.size(s) == most), F.lit(0))

    return _formula_text(let(F.array_compact(F.transform(fragments(F.trim(smiles)), atom_symbols)), longest))


def parse_formula(formula: Column, repeated: str = "last") -> Column:
    """Map element -> count; a missing count is one. ``repeated`` elements: ``last`` or ``sum``."""
    symbols = F.regexp_extract_all(formula, F.lit(FORMULA_PART), F.lit(1))
    digits = F.regexp_extract_all(formula, F.lit(FORMULA_PART), F.lit(2))
    zero = F.lit(0).cast("long")

    def part(symbol: Column, digit: Column) -> Column:
        n = F.when(digit == "", F.lit(1).cast("long")).otherwise(digit.try_cast("long"))
        return F.struct(symbol.alias("symbol"), n.alias("n"))

    def to_map(parts: Column) -> Column:
        def entry(symbol: Column) -> Column:
            same = F.transform(F.filter(parts, lambda x: x["symbol"] == symbol), lambda x: x["n"])
            n = F.aggregate(same, zero, lambda acc, m: acc + m) if repeated == "sum" else F.element_at(same, -1)
            return F.struct(symbol.alias("symbol"), n.alias("n"))

        return F.map_from_entries(F.transform(F.array_distinct(F.transform(parts, lambda x: x["symbol"])), entry))

    return let(F.zip_with(symbols, digits, part), to_map)


def atom_total(formula: Column) -> Column:
    """Number of atoms in a formula; NULL when there are none."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    digits = F.regexp_extract_all(formula, F.lit(FORMULA_PART), F.lit(2))
    total = F.aggregate(digits, zero, lambda acc, n: acc + F.when(n == "", one).otherwise(n.try_cast("long")))
    return let(total, lambda n: F.when(n != zero, n))


def formula_delta(reference: Column, read: Column, skip_hydrogen: bool = False) -> Column:
    """Array of (element, read minus reference), by element, differences only."""
    zero = F.lit(0).cast("long")

    def subtract(pair: Column) -> Column:
        have, want = pair["have"], pair["want"]
        elements = F.array_sort(F.array_union(F.map_keys(have), F.map_keys(want)))
        if skip_hydrogen:
            elements = F.array_remove(elements, "H")
        return F.transform(
            elements,
            lambda e: F.struct(
                e.alias("element"),
                (F.coalesce(F.try_element_at(have, e), zero) - F.coalesce(F.try_element_at(want, e), zero)).alias("delta"),
            ),
        )

    both = F.struct(parse_formula(read).alias("have"), parse_formula(reference).alias("want"))
    return F.filter(let(both, subtract), lambda d: d["delta"] != 0)


def formula_delta_note(reference: Column, read: Column, skip_hydrogen: bool = False) -> Column:
    """``C 1 more, N 2 fewer``; empty when the compositions agree."""
    words = F.transform(
        formula_delta(reference, read, skip_hydrogen),
        lambda d: F.concat(
            d["element"],
            F.lit(" "),
            F.abs(d["delta"]).cast("string"),
            F.when(d["delta"] > 0, " more").otherwise(" fewer"),
        ),
    )
    return F.array_join(words, ", ")


def hill_formula(counts: Column) -> Column:
    """Hill order of a map element -> count: C, H, then alphabetical; all alphabetical without C."""

    def write(table: Column) -> Column:
        kinds = F.array_sort(F.map_keys(table))
        first = F.array_intersect(F.array(F.lit("C"), F.lit("H")), kinds)
        ordered = F.when(F.array_contains(kinds, "C"), F.concat(first, F.array_except(kinds, first))).otherwise(kinds)
        part = lambda k: F.concat(k, F.when(table[k] > 1, table[k].cast("string")).otherwise(""))
        return F.array_join(F.transform(ordered, part), "")

    return let(counts, write)


def unreadable_marks(smiles: Column) -> Column:
    """Why a structure string is no reading at all, or NULL: wildcard atoms, or too many pieces."""
    stars = _count(smiles, "*")
    pieces = F.size(F.filter(fragments(smiles), lambda p: F.trim(p) != ""))
    return F.when(stars > 0, F.concat(F.lit("wildcards:"), stars.cast("string"))).when(
        pieces > MAX_FRAGMENTS, F.concat(F.lit("fragments:"), pieces.cast("string"))
    )


def nonsense_size(reference_formula: Column, read_formula: Column) -> Column:
    """True when the reading is too large, absolutely and against the reference, to be one."""
    return let(
        atom_total(read_formula),
        lambda n: (n >= NONSENSE_ATOM_FLOOR) & (n >= atom_total(reference_formula) * NONSENSE_ATOM_RATIO),
    )
