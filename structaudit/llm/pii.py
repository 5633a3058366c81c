"""Personal data: regular expressions propose spans, checksums confirm, nearby words adjust.

Built-in functions only. A kind's matches and the pieces of text between them come from the same
pattern, so a match's place is the sum of the lengths before it, in code points.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structaudit.functions.binding import let
from structaudit.llm.common import text_rows

#: Each pattern matches what the base pattern of its kind would, left to right; possessive
#: repeats and the looks behind only spare the search from starting again inside a failed run.
#: Card runs outside 14 to 19 digits can never pass, so they are not proposed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

CONTEXT = 40
#: Numbers added up together, and code points in a piece of a text: they bound copying, not what is found.
RUN, PIECE = 256, 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this cannot hold a match.
    needs: str | None
    #: Score of a confirmed match, in hundredths, before context.
    score: int
    near: str
    against: str
    base: bool = True


KINDS = (
    Kind("email", EMAIL, "@", 90, "mail|contact|write|adresse|correo", "example|noreply"),
    Kind("ip", IP, None, 60, "ip|host|server|address|login|client", "version|release|build|section|chapter"),
    Kind("card", CARD, None, 80, "card|visa|credit|debit|payment|karte|carte|tarjeta", "order|isbn|tracking|serial|invoice"),
    Kind("phone", PHONE, "+", 70, "phone|call|tel|fax|mobile|cell|anruf|appel", "version|offset|utc|gmt"),
    Kind("iban", IBAN, None, 80, "iban|account|bank|konto|compte|cuenta", "serial|part|model", False),
    Kind("national", NATIONAL, "-", 40, "ssn|social|security|national|identity|passport", "part|serial|model|order", False),
)
#: Spans of the added kinds are kept from this score on; those of the base kinds always stay.
KEEP = 60

def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go last."""
    s = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(r: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "))).between(15, 34) & mod97(F.replace(hit, F.lit(" ")))
    return F.lit(True)


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the numbers, those before it put together by ``add``, from 0 on.

    An array that grows by one is copied each time, so the numbers are taken in runs of ``RUN``: what
    each run adds up to, where each run begins, and then the places inside it.
    """
    zero = F.lit(0).cast("bigint")

    def grown(numbers: Column, first: Column) -> Column:
        return F.aggregate(numbers, F.array(first), lambda done, v: F.concat(done, F.array(add(F.element_at(done, -1), v))))

    def places(cut: Column) -> Column:
        begins = grown(F.transform(cut, lambda run: F.aggregate(run, zero, add)), zero)
        return let(begins, lambda at: F.flatten(F.transform(cut, lambda run, k: F.slice(grown(run, F.get(at, k)), F.lit(1), F.size(run)))))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))
    return F.when(F.size(values) > 0, let(runs, places)).otherwise(F.array().cast("array<bigint>"))


def _placed(hits: Column, pieces: Column) -> Column:
    """Matches with their places and the text beside them, from matches and the pieces between."""
    lengths = F.transform(hits, lambda hit, i: (F.length(F.get(pieces, i)) + F.length(hit)).cast("bigint"))

    def spans(before: Column) -> Column:
        def span(hit: Column, i: Column) -> Column:
            return let(F.get(before, i) + F.length(F.get(pieces, i)), lambda start: F.struct(
                start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"),
                F.right(F.get(pieces, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)).alias("after"),
            ))

        return F.transform(hits, span)

    return let(let(lengths, lambda n: running(n, lambda x, y: x + y)), spans)


def _scored(kind: Kind, rank: int, spans: Column) -> Column:
    """Confirmed spans of one kind as (start, rank, kind, end, score)."""

    def score(s: Column) -> Column:
        around = F.lower(F.concat_ws(" ", s["before"], s["after"]))
        return (
            F.lit(kind.score)
            + F.when(around.rlike(rf"(?<![a-z])(?:{kind.near})"), 20).otherwise(0)
            - F.when(around.rlike(rf"(?<![a-z])(?:{kind.against})"), 30).otherwise(0)
        )

    made = F.transform(
        F.filter(spans, lambda s: _valid(kind.name, s["hit"])),
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), s["end"].alias("end"),
            F.least(F.lit(100), score(s)).alias("score"),
        ),
    )
    return made if kind.base else F.filter(made, lambda s: s["score"] >= KEEP)


def with_spans(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the spans of personal data in column ``text`` (not null) as column ``out``."""
    names = [f"_{part}_{k.name}" for k in KINDS for part in ("hits", "pieces")]
    cut = rows.select(
        "*",
        *[c for k in KINDS for c in (
            _if_needed(k, text, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)), F.array().cast("array<string>")).alias(f"_hits_{k.name}"),
            _if_needed(k, text, F.split(text, k.pattern, -1), F.array(text)).alias(f"_pieces_{k.name}"),
        )],
    )
    placed = cut.withColumns({f"_at_{k.name}": _placed(F.col(f"_hits_{k.name}"), F.col(f"_pieces_{k.name}")) for k in KINDS}).drop(*names)
    found = F.concat(*[_scored(k, i, F.col(f"_at_{k.name}")) for i, k in enumerate(KINDS)])
    return placed.withColumn(out, F.array_sort(found)).drop(*[f"_at_{k.name}" for k in KINDS])


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text: doc_id, text, spans (start, rank, kind, end, score).

    Places count code points, the end is exclusive, spans are sorted by start and then kind.
    Matches of the four base kinds never depend on their score. A null or empty text has no spans;
    repeated rows are answered one by one; extra columns are ignored; an empty table gives no rows.
    """
    return with_spans(text_rows(docs).withColumn("text", F.coalesce("text", F.lit(""))), "text", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with every span in ``text`` replaced by its kind in brackets.

    A column ``n_chars`` gets the new length where it had one. A null text stays null. The text and the
    other columns travel as one struct, so no column of ``docs`` can clash with those used here.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    new = with_spans(whole, "_text", "_spans").select("_row", redacted(F.col("_text"), F.col("_spans")).alias("_new"))
    changed = {
        "text": F.when(F.col("_row.text").isNotNull(), F.col("_new")),
        "n_chars": F.when(F.col("_row.n_chars").isNotNull(), F.length("_new").cast("bigint")) if "n_chars" in docs.columns else None,
    }
    return new.select(*[(changed[c] if c in changed else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _if_needed(kind: Kind, text: str, found: Column, otherwise: Column) -> Column:
    return found if kind.needs is None else F.when(F.contains(F.col(text), F.lit(kind.needs)), found).otherwise(otherwise)


def span_list(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    spans = F.filter(spans, lambda s: s["rank"] < sum(k.base for k in KINDS)) if base_only else spans
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans a later one keeps what lies beyond those before.

    What lies between spans is put together from pieces of ``PIECE`` code points, because looking for a place in a long text
    begins at its start.
    """
    def made(pieces: Column, spans: Column, ends: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE)
            met = F.transform(F.sequence(first, F.greatest(first, F.floor((end - 1) / PIECE))), lambda k: F.coalesce(F.get(pieces, k.cast("int")), F.lit("")))
            return F.when(end > start, F.substring(F.array_join(met, ""), (start % PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")

        def shown(s: Column, i: Column) -> Column:
            kept = F.concat(between(F.get(ends, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.when(s["end"] <= F.get(ends, i), "").otherwise(kept)

        done = F.greatest(F.get(ends, F.size(spans) - 1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.transform(spans, shown), ""), between(done, F.length(text).cast("bigint")))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    changed = let(F.struct(pieces.alias("pieces"), ends.alias("ends")), lambda x: made(x["pieces"], spans, x["ends"]))
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


digest = functools.partial(F.sha2, numBits=256)
