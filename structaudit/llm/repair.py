"""Conversation structure repair: generalised LR over the roles with weighted edits.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. A table built from the
grammar drives a graph-structured stack: a node is a parser state, a link leads to the node below
and carries the cheapest (cost, audit) of all edits that lead there. Keep, rerole and insert shift a
role, delete leaves the stack; stacks with equal tops are merged by the smaller (cost, audit).

Long conversations are cut by ranges of turns. A cut is parsed from every stack that may lie below
it, so cuts run in parallel and are then chained; no task holds a conversation.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from structaudit.llm.common import checkpointed

#: Conversation -> nothing | turns | s turns; turns -> pair | turns pair; pair -> u a.
GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a")))
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turn numbers in one cut of a conversation.
CUT_TURNS = 4096
INK = re.compile(r"[^\x20\x09-\x0D]")


class Table:
    """LR(0) states of a grammar without shift-reduce choices before its start symbol is complete."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] = GRAMMAR):
        self.rules, heads = rules, {h for h, _ in rules}
        start = rules[0][0]

        def closure(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            todo = list(items)
            while todo:
                rule, dot = todo.pop()
                body = rules[rule][1]
                if dot < len(body) and body[dot] in heads:
                    fresh = {(i, 0) for i, (h, _) in enumerate(rules) if h == body[dot]} - items
                    items |= fresh
                    todo += fresh
            return frozenset(items)

        first = closure({(i, 0) for i, (h, _) in enumerate(rules) if h == start})
        number, self.goto, queue = {first: 0}, [], [first]
        for items in queue:
            moves: dict[str, set[tuple[int, int]]] = {}
            for rule, dot in items:
                if dot < len(rules[rule][1]):
                    moves.setdefault(rules[rule][1][dot], set()).add((rule, dot + 1))
            out = {}
            for symbol, kernel in moves.items():
                to = closure(kernel)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                out[symbol] = number[to]
            self.goto.append(out)
        complete = [[r for r, dot in items if dot == len(rules[r][1])] for items in queue]
        #: A rule to reduce by at once, and the states in which the input may end.
        self.reduce = [next((r for r in done if rules[r][0] != start), None) for done in complete]
        self.accepts = [any(rules[r][0] == start for r in done) for done in complete]
        self.symbols = sorted({s for _, body in rules for s in body if s not in heads})

    def shift(self, stack: tuple, symbol: str) -> tuple | None:
        """The linked stack (state, rest) after ``symbol`` and every reduction it allows."""
        to = self.goto[stack[0]].get(symbol)
        if to is None:
            return None
        stack = (to, stack)
        while (rule := self.reduce[stack[0]]) is not None:
            head, body = self.rules[rule]
            for _ in body:
                stack = stack[1]
            stack = (self.goto[stack[0]][head], stack)
        return stack


LEGAL = {"su", "ua", "au"}
TABLE = Table()
BOTTOM = (0, None)


def _stacks() -> list[tuple]:
    """Every stack that some prefix leads to; the grammar has no nesting, so there are few."""
    found = [BOTTOM]
    for stack in found:
        for symbol in TABLE.symbols:
            to = TABLE.shift(stack, symbol)
            if to is not None and to not in found:
                found.append(to)
    return found


STACKS = _stacks()
#: Shifts between stacks by their numbers.
SHIFT = [{s: STACKS.index(to) for s in TABLE.symbols if (to := TABLE.shift(stack, s)) is not None} for stack in STACKS]
FINAL = [i for i, stack in enumerate(STACKS) if TABLE.accepts[stack[0]]]

Tops = dict[int, tuple[int, str]]


def _merge(tops: Tops, top: int, cost: int, audit: str) -> bool:
    if top not in tops or (cost, audit) < tops[top]:
        tops[top] = (cost, audit)
        return True
    return False


def _inserted(tops: Tops) -> Tops:
    """``tops`` and what inserting user or assistant makes of them."""
    todo = list(tops)
    while todo:
        top = todo.pop()
        cost, audit = tops[top]
        for symbol in NAMES:
            to = SHIFT[top].get(symbol)
            if to is not None and _merge(tops, to, cost + INSERT, audit + "I"):
                todo.append(to)
    return tops


@functools.lru_cache(maxsize=1 << 14)
def parse(rows: tuple[str, ...], start: int = 0) -> Tops:
    """Cheapest (cost, audit) by final stack for ``rows`` of role initial and fault, begun on stack ``start``.

    The fault is ``b`` (blank), ``d`` (duplicate), ``t`` (truncated) or ``-``. Equal costs are told
    apart by the audit; audits of one cost and place are never prefixes of each other, as only an
    insertion reads no row and it costs, so the smaller one stays the smaller whatever follows.
    """
    tops = _inserted({start: (0, "")})
    for row in rows:
        role, fault, after = row[:-1], row[-1], {}
        more = TRUNCATED if fault == "t" else 0
        for top, (cost, audit) in tops.items():
            _merge(after, top, cost + DELETE, audit + "D")
            if fault in "bd":
                continue
            kept = SHIFT[top].get(role)
            if kept is not None:
                _merge(after, kept, cost + more, audit + "K")
            for symbol in NAMES:
                to = SHIFT[top].get(symbol)
                if to is not None:
                    _merge(after, to, cost + REROLE + more, audit + "R")
        tops = _inserted(after)
    return tops


def ended(tops: Tops) -> tuple[int, int, str]:
    """(stack, cost, audit) of the cheapest parse in a stack that may end."""
    return min(((top, *tops[top]) for top in FINAL if top in tops), key=lambda x: x[1:])


def rebuilt(rows: list[tuple[str, str]], audit: str, start: int = 0) -> tuple[list[str], int]:
    """``role:text`` of the repaired rows, and the stack after them."""
    top, at, out = start, 0, []
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            symbol = role[:1]
        else:
            # Every stack takes at most one of the two, so the audit names the role.
            symbol = next(s for s in NAMES if s in SHIFT[top])
            role = NAMES[symbol]
        top = SHIFT[top][symbol]
        out.append(f"{role}:{text}")
    return out, top


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that ``crc32(conv_id:turn) % 20`` names.

    0 drops a row, 1 empties its text, 2 takes away ``[.!?]``, 3 repeats it, 4 makes its role user.
    Null roles and texts, and null ids within the checksum, read as one space.
    """
    kind = F.crc32(F.concat_ws(":", _or_space("conv_id"), _or_space("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        _or_space("role").alias("role"), _or_space("text").alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


FIRST = -(1 << 62)


def _cut(rows: DataFrame, turns: int) -> DataFrame:
    """``rows`` with their cut, whether the conversation has several, and whether role and text came in an earlier turn."""
    mark = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    cut = F.when(F.col("turn").isNull(), FIRST).otherwise(F.floor(F.col("turn") / turns)).cast("bigint")
    marked = rows.withColumns({"at": F.coalesce("turn", F.lit(-(1 << 63))), "cut": cut, "mark": mark})
    # Only digests are grouped; the texts stay where they are.
    seen = marked.groupBy("conv_id", "mark").agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).where("earliest < latest")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "earliest")
    long = marked.groupBy("conv_id").agg((F.min("cut") < F.max("cut")).alias("several")).where("several")
    long = long.select(F.col("conv_id").alias("k"), "several")
    met = marked.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    met = met.join(long, F.col("conv_id").eqNullSafe(F.col("k")), "left")
    return met.select(
        "conv_id", F.coalesce("several", F.lit(False)).alias("several"), "cut", "turn", "role", "text",
        F.coalesce(F.col("at") > F.col("earliest"), F.lit(False)).alias("repeated"),
    )


def _of(longs: str = "", strings: str = "", **others) -> StructType:
    made = StructType()
    for name in longs.split():
        made.add(name, LongType())
    for name in strings.split():
        made.add(name, StringType())
    for name, kind in others.items():
        made.add(name, kind)
    return made


COUNTS = "blank duplicate truncated illegal"
CUT = _of(
    f"conv_id cut {COUNTS} low high turns", "head tail repaired_sha256", several=BooleanType(),
    tops=ArrayType(_of("start top cost", "audit")),
)
WAY = _of("conv_id cut start", "audit")
REPAIRED = _of(f"conv_id gaps {COUNTS} cost", "audit repaired_sha256", ways=ArrayType(WAY))


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows that share ``keys``, from sorted batches."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by(rows: DataFrame, keys: list[str], order: list[str], run: Callable, schema: StructType) -> DataFrame:
    """``run`` over streams of rows that are dealt by ``keys`` and sorted by ``order``; it yields dicts."""
    kinds = to_arrow_schema(schema)

    def batched(batches):
        made = []
        for row in run(batches):
            made.append(row)
            if len(made) == 512:
                yield pa.RecordBatch.from_pylist(made, kinds)
                made = []
        yield pa.RecordBatch.from_pylist(made, kinds)

    return rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(batched, schema)


def signature(rows: list[dict]) -> tuple[str, ...]:
    """Role initial and first fault of each of the sorted rows of a cut."""
    out, before = [], None
    for row in rows:
        now = (row["turn"], row["role"], row["text"])
        if INK.search(row["text"]) is None:
            fault = "b"
        elif row["repeated"] or before == now:
            fault = "d"
        else:
            fault = "-" if row["text"].rstrip(" \t\n\v\f\r")[-1] in ".!?" else "t"
        out.append(row["role"][:1] + fault)
        before = now
    return tuple(out)


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row for each cut: its faults and parses, and what a conversation of one cut is repaired to."""
    for rows in _grouped(batches, ("conv_id", "cut")):
        head, shape = rows[0], signature(rows)
        kinds, initials = [m[-1] for m in shape], [m[:-1] for m in shape]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        starts = range(len(STACKS)) if head["several"] else (0,)
        out = {
            "conv_id": head["conv_id"], "cut": head["cut"], "several": head["several"], "blank": kinds.count("b"),
            "duplicate": kinds.count("d"), "truncated": kinds.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            "head": initials[0], "tail": initials[-1],
            "tops": [
                {"start": s, "top": top, "cost": cost, "audit": audit} for s in starts for top, (cost, audit) in parse(shape, s).items()
            ],
        }
        if not head["several"]:
            lines, _ = rebuilt([(r["role"], r["text"]) for r in rows], ended(parse(shape))[2])
            out["repaired_sha256"] = _digest(lines)
        yield out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row for each conversation, from its cuts in order; with the way through each cut where there are several."""
    for cuts in _grouped(batches, ("conv_id",)):
        now: Tops = {0: (0, "")}
        back: list[dict[int, dict]] = []
        for cut in cuts:
            after: Tops = {}
            steps: dict[int, dict] = {}
            for step in cut["tops"]:
                if step["start"] in now:
                    cost, audit = now[step["start"]]
                    if _merge(after, step["top"], cost + step["cost"], audit + step["audit"]):
                        steps[step["top"]] = step
            now = after
            back.append(steps)
        top, cost, audit = ended(now)
        ways = []
        for cut, steps in zip(reversed(cuts), reversed(back), strict=True):
            ways.append({"conv_id": cut["conv_id"], "cut": cut["cut"], "start": steps[top]["start"], "audit": steps[top]["audit"]})
            top = steps[top]["start"]
        low, high = (f([c[k] for c in cuts if c[k] is not None], default=None) for f, k in ((min, "low"), (max, "high")))
        yield {
            "conv_id": cuts[0]["conv_id"], "cost": cost, "audit": audit,
            "gaps": 0 if low is None else high - low + 1 - sum(c["turns"] for c in cuts),
            **{k: sum(c[k] for c in cuts) for k in COUNTS.split()[:3]},
            "illegal": sum(c["illegal"] for c in cuts) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(cuts, cuts[1:], strict=False)),
            "repaired_sha256": cuts[0]["repaired_sha256"] if len(cuts) == 1 else None, "ways": ways if len(cuts) > 1 else [],
        }


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Digests of long conversations: each cut's way comes first and then its rows, one cut at a time."""
    conv, digest = None, None
    for rows in _grouped(batches, ("conv_id", "cut")):
        way = rows[0]
        if digest is None or way["conv_id"] != conv:
            if digest is not None:
                yield {"conv_id": conv, "long_sha256": digest.hexdigest()}
            conv, digest, begun = way["conv_id"], hashlib.sha256(), False
        lines, _ = rebuilt([(r["role"], r["text"]) for r in rows[1:]], way["audit"], way["start"])
        if lines:
            digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
            begun = True
    if digest is not None:
        yield {"conv_id": conv, "long_sha256": digest.hexdigest()}


def repair_conversations(rows: DataFrame, cut_turns: int = CUT_TURNS) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text): faults, gaps, cheapest edits, digest.

    Rows are taken by turn, nulls first, and within a turn by role and text. A row's first fault counts:
    blank, duplicate (role and text came before), truncated (does not end in ``.!?``). Null roles and
    texts read as one space, a null conv_id is a conversation of its own, repeated rows are duplicates,
    extra columns are ignored, an empty table gives no rows. A text of any length counts whole. Rows
    of one turn of one conversation stay together; all else is dealt by cuts of ``cut_turns`` turn numbers.
    """
    kept = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        _or_space("role").alias("role"), _or_space("text").alias("text"),
    )
    cut = _cut(kept, cut_turns)
    order = ["conv_id", "cut", "turn", "role", "text"]
    cuts = _by(cut, ["conv_id", "cut"], order, _parsed, CUT)
    done = checkpointed(_by(cuts, ["conv_id"], ["conv_id", "cut"], _chained, REPAIRED))
    ways = done.select(F.inline("ways")).select("conv_id", "cut", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "start", "audit", F.lit(0).alias("kind"))
    said = cut.where("several").select("conv_id", "cut", "turn", "role", "text", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    hashed = _by(ways.union(said), ["conv_id"], ["conv_id", "cut", "kind", "turn", "role", "text"], _hashed, _of("conv_id", "long_sha256"))
    hashed = hashed.withColumnRenamed("conv_id", "k")
    return done.join(hashed, F.col("conv_id").eqNullSafe(F.col("k")), "left").select(
        "conv_id", "gaps", *COUNTS.split(), "cost", "audit", F.coalesce("repaired_sha256", "long_sha256").alias("repaired_sha256"),
    )


def repaired_after_damage(conversations: DataFrame, cut_turns: int = CUT_TURNS) -> DataFrame:
    """:func:`repair_conversations` of the damaged rows, for every original conv_id; zeros where no row is left."""
    found = repair_conversations(damaged(conversations), cut_turns)
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("k")).distinct()
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", *COUNTS.split(), "cost")}
    strings = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(_digest([])))}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("k")), "left").withColumns(zeros | strings).select(
        F.col("k").alias("conv_id"), *zeros, *strings,
    )
