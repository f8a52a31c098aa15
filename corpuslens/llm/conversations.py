"""Structure of conversations: faults of turns, and the cheapest edits that make the roles alternate.

The roles' initials must follow the grammar ``(s?(ua)+)?``, whose states are START, S (after a system turn), U and A.
Edits are Keep (costs 0), Rerole to user or assistant (2), Delete (3; the only one for blank and duplicate turns) and Insert an
empty turn of user or assistant (2, anywhere); a truncated turn that stays adds 1. The cheapest edits are found in cost layers
in the manner of Wu and Manber: for each place of a conversation and each increasing cost a bitset of the grammar's
states from which the end can be reached at that cost. The first layer that holds START at the first place gives the
cost, and a trace along the bits gives the edits, the least letter first where several are as cheap. A place's states are
never more than a few layers apart, so it is kept as the number of the layer where its first bit is set and the few bitsets
from there on; and few such bitsets differ, so a step is looked up once it is known.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, S, U, A = 1, 2, 4, 8
ALL, ENDS = START | S | U | A, START | A
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
#: A turn's code: its initial (anything but these is ``x``) and its first fault.
BLANK, DUPLICATE, CUT, NONE = "B", "D", "T", "-"
CODES = [a + b for a in "suax" for b in (BLANK, DUPLICATE, CUT, NONE)]
NUMBER = {c: i for i, c in enumerate(CODES)}

Layers = tuple[int, ...]


def after(state: int, initial: str) -> int:
    """The state after a role with this initial, 0 if the grammar has none."""
    if initial == "s":
        return S if state == START else 0
    if initial == "u":
        return U if state & (START | S | A) else 0
    return A if initial == "a" and state == U else 0


def before(states: int, initials: str) -> int:
    """The states from which one of these initials leads into a set of states."""
    return sum(q for q in (START, S, U, A) if any(after(q, x) & states for x in initials))


def added(state: int) -> int:
    """The state after the one role that can be put in anywhere: assistant after user, else user."""
    return A if state == U else U


class Repairs:
    """Cost layers with the steps met so far."""

    def __init__(self) -> None:
        self.layers: list[Layers] = []
        self.number: dict[Layers, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.edits: dict[tuple[int, int, int, str, int], tuple[str, int]] = {}
        self.end = self._numbered(self._grown(lambda c: ENDS)[1])

    def _numbered(self, layers: Layers) -> int:
        if layers not in self.number:
            self.number[layers] = len(self.layers)
            self.layers.append(layers)
        return self.number[layers]

    @staticmethod
    def _grown(reached) -> tuple[int, Layers]:  # noqa: ANN001
        """Layers of a place: what ``reached`` gives at each cost, what inserts add, and what was there at less. The number of
        empty layers, and the rest up to the first full one."""
        out: list[int] = []
        while not out or out[-1] != ALL:
            c = len(out)
            out.append(reached(c) | (before(out[c - INSERT], "ua") if c >= INSERT else 0) | (out[c - 1] if c else 0))
        first = next(i for i, x in enumerate(out) if x)
        return first, tuple(out[first:])

    def step(self, later: int, code: str) -> tuple[int, int]:
        """From the layers of a place to those of the one before it, over a turn: by how many costs they begin later."""
        found = self.steps.get((later, code))
        if found is None:
            have = self.layers[later]

            def at(c: int) -> int:
                return 0 if c < 0 else have[min(c, len(have) - 1)]

            def reached(c: int) -> int:
                out = at(c - DELETE)
                if code[1] in (NONE, CUT):
                    more = TRUNCATED if code[1] == CUT else 0
                    out |= before(at(c - more), code[0]) | before(at(c - REROLE - more), "ua")
                return out

            shift, layers = self._grown(reached)
            found = self.steps[later, code] = shift, self._numbered(layers)
        return found

    def least(self, layers: int, state: int) -> int:
        """The first of a place's layers that holds a state."""
        return next(c for c, x in enumerate(self.layers[layers]) if x & state)

    def edit(self, here: int, later: int, shift: int, code: str, state: int) -> tuple[str, int]:
        """The least cheapest edits up to and with those of a turn, and the state after them."""
        found = self.edits.get((here, later, shift, code, state))
        if found is None:
            left, letters, q = self.least(here, state) + shift, "", state  # against the layers of the later place
            more = TRUNCATED if code[1] == CUT else 0
            while True:
                if self.least(later, q) + DELETE == left:
                    letters += "D"
                    break
                if self.least(here, added(q)) + shift + INSERT == left:
                    letters, q, left = letters + "I", added(q), left - INSERT
                    continue
                q, letters = (to, letters + "K") if (to := after(q, code[0])) and self.least(later, to) + more == left else (added(q), letters + "R")
                break
            found = self.edits[here, later, shift, code, state] = letters, q
        return found

    def audit(self, codes: bytes | bytearray) -> tuple[int, str]:
        """The cost of the cheapest edits of a conversation, and their letters. codes: places in ``CODES``."""
        places, shifts, cost = array("H", [self.end]), array("B"), 0
        for code in reversed(codes):
            shift, layers = self.step(places[-1], CODES[code])
            places.append(layers)
            shifts.append(shift)
            cost += shift
        cost += self.least(places[-1], START)
        out, q = [], START
        for i, code in enumerate(codes):
            k = len(codes) - 1 - i
            letters, q = self.edit(places[k + 1], places[k], shifts[k], CODES[code], q)
            out.append(letters)
        while self.least(self.end, q):
            out.append("I")
            q = added(q)
        return cost, "".join(out)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, here`` after damage by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a turn (its row
    stays with ``here`` false), 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes it the user's. Nulls of
    any column count as one space, but ids and turns stay null."""
    own = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))]).na.fill(" ", ["role", "text"])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (kind != 0).alias("here"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return out.select("conv_id", "turn", "role", "text", "here", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_")).drop("_")


def _code(initial: Column, same: Column, text: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(same, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE)
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@dataclass(frozen=True)
class Checked:
    """``turns``: ``conv_id, place`` (from 1)``, turn, role, text, code`` of every turn, in a written table; ``audits``: a row a
    conversation, ``conv_id`` and the columns of ``AUDIT``, written too."""

    turns: DataFrame
    audits: DataFrame


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns sorted by conversation and place."""
    repairs, now, codes, out = Repairs(), None, bytearray(), []
    low = high = last = None
    kinds = illegal = 0
    kind = pa.int64()

    def done() -> None:
        cost, audit = repairs.audit(codes)
        gaps = 0 if low is None else high - low + 1 - kinds
        faults = [sum(codes.count(NUMBER[a + f]) for a in "suax") for f in (BLANK, DUPLICATE, CUT)]
        out.append((now[0], gaps, *faults, illegal, cost, audit))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 8
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], ["conv_id", *_COLUMNS, "audit"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for conv, turn, here, code, bad in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "here", "code", "bad")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done()
                now, codes, low, high, last, kinds, illegal = (conv,), bytearray(), None, None, None, 0, 0
            if not here:
                continue
            codes.append(NUMBER[code])
            illegal += bad
            if turn is not None:
                low, high = turn if low is None else low, turn
                kinds += turn != last
                last = turn
        yield batch_of()
    if now is not None:
        done()
        yield batch_of()


def check(rows: DataFrame) -> Checked:
    """Faults and cheapest edits of conversations.

    rows: ``conv_id, turn, role, text`` without nulls in the last two, and ``here``: rows where it is false only name a
    conversation that may have no other. Turns stand in ascending order, nulls first, and those of one turn in the order of
    their roles and texts. A turn's first fault counts: blank, duplicate (role and text of an earlier one, also of an equal row
    beside it), truncated (the last character that is no white space is none of ``.!?``). ``illegal``: neighbours whose
    roles' initials are none of su, ua, au. A null id is a conversation like others; an empty table gives none. A
    conversation is sorted on disk where memory doesn't hold it and streamed; a task keeps four bytes a turn of one.
    """
    place = Window.partitionBy("conv_id").orderBy(F.desc("here"), F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.asc_nulls_first("turn"))
    initial = F.substring("role", 1, 1)
    own = rows.select("conv_id", "turn", "role", "text", "here").repartition("conv_id")
    own = own.withColumns({"place": F.row_number().over(place), "same": F.row_number().over(same) > 1, "lead": F.lag(initial).over(place)})
    bad = F.col("here") & F.col("lead").isNotNull() & ~F.concat("lead", initial).isin("su", "ua", "au")
    turns = written(own.select("conv_id", "place", "turn", "here", "role", "text", _code(initial, F.col("same"), F.col("text")).alias("code"), bad.alias("bad")), "turns")
    slim = turns.select("conv_id", "place", "turn", "here", "code", "bad").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    audits = written(slim.mapInArrow(_audits, f"conv_id {dict(rows.dtypes)['conv_id']}, {AUDIT}"), "audits")
    return Checked(turns.where("here").select("conv_id", "place", "turn", "role", "text", "code"), audits)


class _Editing:
    """One conversation's edits, applied while its turns come by."""

    def __init__(self, letters: str) -> None:
        self.letters, self.at, self.state = letters, 0, START

    def _add(self) -> str:
        self.state = added(self.state)
        return "user" if self.state == U else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield self._add(), "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns that come before this one and, unless it goes, it itself: role, text, edit."""
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = after(self.state, role[:1])
            yield role, text, "K"
        elif letter == "R":
            yield self._add(), text, "R"


def _streamed(checked: Checked) -> DataFrame:
    """Each conversation's audit and then its turns, in order."""
    nulls = [F.lit(None).cast(k).alias(c) for c, k in (("role", "string"), ("text", "string"))]
    heads = checked.audits.select("conv_id", F.lit(0).alias("place"), *nulls, *_COLUMNS, "audit")
    rows = checked.turns.select("conv_id", "place", "role", "text", *[F.lit(None).cast("long").alias(c) for c in _COLUMNS], F.lit(None).cast("string").alias("audit"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repaired(checked: Checked) -> DataFrame:
    """``conv_id, place`` (from 1)``, role, text, edit`` (K, R or I) of the turns of the repaired conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, n, out = None, None, 0, []

        def take(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal n
            for x in found:
                n += 1
                out.append((conv, n, *x))

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "place", "role", "text", "edit"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("conv_id").type
            for key, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True):
                if audit is not None:
                    if edits:
                        take(edits.inserted())
                    edits, conv, n = _Editing(audit), key, 0
                else:
                    take(edits.turn(role, text))
            yield batch_of(kind)
        if edits:
            take(edits.inserted())
            yield batch_of(kind)

    return _streamed(checked).mapInArrow(run, f"conv_id {dict(checked.turns.dtypes)['conv_id']}, place long, role string, text string, edit string")


def digests(checked: Checked) -> DataFrame:
    """The audits with ``repaired_sha256``: of the repaired turns as ``role:text``, joined by line ends; that of the empty text
    where none is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, head, sha, first, out = None, None, None, True, []

        def take(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for role, text, _ in found:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def batch_of(schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            columns = ["conv_id", *_COLUMNS, "audit"]
            schema = schema or pa.schema([*(batch.schema.field(c) for c in columns), pa.field("repaired_sha256", pa.string())])
            values = [batch.column(c).to_pylist() for c in columns]
            for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if values[-1][i] is not None:
                    if edits:
                        take(edits.inserted())
                        out.append((*head, sha.hexdigest()))
                    head, edits, sha, first = [v[i] for v in values], _Editing(values[-1][i]), hashlib.sha256(), True
                else:
                    take(edits.turn(role, text))
            yield batch_of(schema)
        if edits:
            take(edits.inserted())
            out.append((*head, sha.hexdigest()))
            yield batch_of(schema)

    return _streamed(checked).mapInArrow(run, f"conv_id {dict(checked.turns.dtypes)['conv_id']}, {AUDIT}, repaired_sha256 string")
