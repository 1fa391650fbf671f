"""Conversation structure repair by weighted CYK parsing over spans of rows.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  The repair
grammar is in Chomsky normal form.  Its nonterminals N(p, q) stand for edited rows that lead the
pattern from state p to state q (0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept):
``N(p, q) -> N(p, r) N(r, q)`` and ``N(p, q) -> edit of one row``.  A cell holds the least (cost,
audit) of its span, audits compared by ASCII; audits of one cost and span are never prefixes of
each other, so least parts make least wholes.  Inserted rows enter by the insertion closure of
the terminal cells, on both sides.  N(p, r) N(r, q) is the same cell wherever a span is split, so
spans are combined bottom-up by length 1, 2, 4, ... with one split each instead of all of them.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation with a third
of all rows is spread over tasks.  One pass parses every conversation that lies inside a range.
Those at the borders of ranges go on as rows: their repeated rows are found by a grouped join,
each range gives the cells of its part, parts are combined in order, and the repaired rows are
streamed in order (the digest of one conversation is a sequential function; its memory is
constant).

Defined results: rows are ordered by turn (null first), ties by role and text; null role or text
is one space; rows without conv_id are one conversation, with null as its id; a row with an empty
role has no initial and is never kept as it is; a conversation without rows has zeros, an empty
audit and the digest of an empty text; repeated rows are rows; extra columns are not read,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.llm.common import pick, small_batches, staged

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
START, ACCEPT, STATES = 0, (0, 3), range(4)
#: state -> {initial: next state}
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
SPACE = " \t\n\r\x0b\x0c"
#: Conversations of so few rows, at most so many a task, are looked up by the kinds of their rows.
REMEMBER_ROWS, REMEMBERED = 64, 65_536

# A row's kind is one letter: its initial (x: another one), upper case if it is truncated, or d if
# it must be deleted.


def _least(a, b):
    return b if a is None or (b is not None and b < a) else a


def combine(left, right):
    """Cells of a span from those of its two parts: N(p, q) -> N(p, r) N(r, q)."""
    out = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                x, y = left[4 * p + r], right[4 * r + q]
                if x is not None and y is not None:
                    cost = x[0] + y[0]
                    if best is None or cost <= best[0]:
                        best = _least(best, (cost, x[1] + y[1]))
            out.append(best)
    return tuple(out)


#: Cells of no rows at all.
EMPTY = tuple((0, "") if p == q else None for p in STATES for q in STATES)


def insertions():
    """The closure of inserting rows: cheapest inserted rows that lead from p to q."""
    step = [None] * 16
    for p in STATES:
        for initial, q in MOVES[p].items():
            if initial in ROLES:
                step[4 * p + q] = (COST[INSERT], INSERT)
    cells = EMPTY
    while True:
        more = tuple(map(_least, cells, combine(cells, step)))
        if more == cells:
            return cells
        cells = more


def terminal(kind: str):
    """Cells of one row, closed under insertions before and after it."""
    cells = [None] * 16

    def edit(p, q, cost, name):
        cells[4 * p + q] = _least(cells[4 * p + q], (cost, name))

    extra = TRUNCATED_COST if kind.isupper() else 0
    for p in STATES:
        edit(p, p, COST[DELETE], DELETE)
        for initial, q in MOVES[p].items() if kind != "d" else ():
            if initial == kind.lower():
                edit(p, q, COST[KEEP] + extra, KEEP)
            if initial in ROLES:
                edit(p, q, COST[REROLE] + extra, REROLE)
    return combine(combine(insertions(), cells), insertions())


class Parser:
    """Cells of the terminals, and the results of short conversations seen before."""

    def __init__(self):
        self.terminals = {k: terminal(k) for k in "suaxSUAXd"}
        self.known: dict[str, tuple[int, str]] = {}

    def parse(self, kinds: str):
        """Cells of a sequence of rows, bottom-up by span length."""
        level = [self.terminals[k] for k in kinds] or [EMPTY]
        while len(level) > 1:
            level = [combine(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def solve(self, kinds: str) -> tuple[int, str]:
        """(cost, audit) of a whole conversation; deleting everything is always a way."""
        if (best := self.known.get(kinds)) is None:
            cells = self.parse(kinds)
            best = min(cells[4 * START + q] for q in ACCEPT if cells[4 * START + q] is not None)
            if len(kinds) <= REMEMBER_ROWS and len(self.known) < REMEMBERED:
                self.known[kinds] = best
        return best


def repaired(rows, audit: str):
    """(role, text) of the repaired conversation, from its (role, text) rows in order."""
    state, rows = START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        initial = role[:1] if edit == KEEP else "a" if state == 2 else "u"
        yield (role if edit == KEEP else ROLES[initial]), text
        state = MOVES[state][initial]


def kind_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(kind, fault) of a row; fault is b(lank), d(uplicate), t(runcated) or empty."""
    words = text.strip(SPACE)
    if not words or seen:
        return "d", "d" if words else "b"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (initial.upper(), "t") if words[-1] not in ".!?" else (initial, "")


def illegal(a: str, b: str) -> bool:
    return (a, b) not in (("s", "u"), ("u", "a"), ("a", "u"))


class _Tally:
    """Faults and turns of rows in order."""

    def __init__(self):
        self.faults, self.illegal, self.head, self.tail = "", 0, None, None
        self.low = self.high = None
        self.turns, self.kinds = 0, []

    def add(self, turn, initial: str, kind: str, fault: str) -> None:
        if self.head is None:
            self.head = initial
        elif illegal(self.tail, initial):
            self.illegal += 1
        self.tail = initial
        self.faults += fault
        self.kinds.append(kind)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def counts(self) -> list[int]:
        return [*map(self.faults.count, "bdt"), self.illegal]

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
REPORT = ["conv_id", *_COUNT_NAMES, "repaired_sha256"]
_PAGE = 500


def _digest(pairs) -> str:
    h, rest = hashlib.sha256(), False
    for role, text in pairs:
        h.update(f"\n{role}:{text}".encode() if rest else f"{role}:{text}".encode())
        rest = True
    return h.hexdigest()


def _tuples(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _pages(rows, schema):
    """Record batches of a stream of tuples."""
    page = []
    for r in rows:
        page.append(r)
        if len(page) == _PAGE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page), schema)], schema=schema)
            page = []
    if page:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page), schema)], schema=schema)


def _report(conv, rows, parser: Parser):
    """A conversation's report from its rows (turn, role, text)."""
    tally, seen = _Tally(), set()
    for turn, role, text in rows:
        tally.add(turn, role[:1], *kind_of(role, text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = parser.solve("".join(tally.kinds))
    return (conv, tally.gaps(), *tally.counts(), cost, audit)


def _arrow(fields: str, conv_type) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(),
             "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string()), "conv": conv_type}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])


def _ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: str | None) -> DataFrame:
    """(conv_id, pos, turn, role, text, gone), dealt by ranges and sorted; pos grows with the order."""
    small_batches(conversations.sparkSession)
    rows = pick(conversations, [id_col, turn_col, role_col, text_col, *([gone] if gone else [])])
    rows = rows.toDF("conv_id", "turn", "role", "text", *(["gone"] if gone else []))
    rows = rows if gone else rows.withColumn("gone", F.lit(False))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), "gone", F.monotonically_increasing_id().alias("row"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "row")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return rows.select("conv_id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "gone")


def _parsed(rows: DataFrame, turns: bool) -> DataFrame:
    """Per conversation its report, or (with ``turns``) its repaired rows; see ``repair``."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    out_cols = "conv_id conv, position bigint, role string, text string" if turns else (
        f"conv_id conv, {COUNTS}, repaired_sha256 string")
    inner = "i_pos bigint, i_turn bigint, i_role string, i_text string, i_gone boolean"
    width = out_cols.count(",") + 1

    def whole(c, mine, parser):
        report = _report(c, mine, parser)
        fixed = repaired([r[1:] for r in mine], report[-1])
        if turns:
            return [(c, i, *pair) for i, pair in enumerate(fixed)]
        return [(*report, _digest(fixed))]

    def scan(batches):
        """Conversations inside the range are finished; the rows of the first and the last go on."""
        def stream():
            first, current, held, parser = True, None, [], Parser()
            for c, pos, turn, role, text, gone in _tuples(batches):
                if not first and c == current[0]:
                    held.append((pos, turn, role, text, gone))
                    continue
                if first and (current is None or c == current[0]):
                    current = (c,)
                    yield (c, *[None] * (width - 1), pos, turn, role, text, gone)
                    continue
                for r in whole(current[0], [h[1:4] for h in held if not h[4]], parser) if not first else ():
                    yield (*r, *[None] * 5)
                first, current, held = False, (c,), [(pos, turn, role, text, gone)]
            for h in held:
                yield (current[0], *[None] * (width - 1), *h)

        batches = iter(batches)
        head = next(batches, None)
        if head is not None:
            schema = _arrow(f"{out_cols}, {inner}", head.schema.field(0).type)
            batches = _chain(head, batches)
            yield from _pages(stream(), schema)

    passed = staged(rows.mapInArrow(scan, f"{out_cols}, {inner}".replace(" conv,", f" {conv},")), "ranges")
    names = [c.split()[0] for c in out_cols.split(", ")]
    done = passed.where("i_pos is null").select(*names)
    rest = passed.where("i_pos is not null").select(
        "conv_id", *[F.col(f"i_{c}").alias(c) for c in ("pos", "turn", "role", "text", "gone")])
    return done.unionByName(_across_ranges(rest, conv, out_cols, turns))


def _chain(head, rest):
    yield head
    yield from rest


def _grouped(batches, fields: str, keys: int, work):
    """Streams consecutive rows with equal first ``keys`` columns to ``work(key, rows)``."""
    batches = iter(batches)
    head = next(batches, None)
    if head is None:
        return
    schema = _arrow(fields, head.schema.field(0).type)

    def stream():
        from itertools import groupby
        for key, rows in groupby(_tuples(_chain(head, batches)), key=lambda r: r[:keys]):
            yield from work(key, rows)

    yield from _pages(stream(), schema)


def _across_ranges(rows: DataFrame, conv: str, out_cols: str, turns: bool) -> DataFrame:
    """The same for conversations at the borders of ranges, whatever their length."""
    ident = F.concat(F.md5("role"), F.md5("text"))
    # turns are short of the text from here on; the first of equal rows is found by a grouped join
    slim = rows.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "gone", ident.alias("h"),
                       F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("words"),
                       F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ended"))
    firsts = slim.where("not gone").groupBy(F.col("conv_id").alias("c2"), F.col("h").alias("h2")).agg(F.min("pos").alias("p2"))
    firsts = staged(firsts, "first-rows")  # a table, so that the join can split a hot text
    slim = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("h") == F.col("h2")), "left")
    fault = F.expr("case when not words then 'b' when pos > p2 then 'd' when not ended then 't' else '' end")
    slim = slim.select("conv_id", F.shiftright("pos", 33).alias("part"), "pos", "turn", "initial", "gone", fault.alias("fault"))
    part_cols = ("conv_id conv, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, "
                 "tail string, low bigint, high bigint, turns bigint, costs costs, audits audits")

    def parts(batches):
        parser = Parser()

        def work(key, mine):
            t = _Tally()
            for _, _, _, turn, initial, gone, fault in mine:
                if not gone:
                    kind = "d" if fault in ("b", "d") else initial if initial in ("s", "u", "a") else "x"
                    t.add(turn, initial, kind.upper() if fault == "t" else kind, fault)
            cells = parser.parse("".join(t.kinds))
            yield (*key, *t.counts(), t.head, t.tail, t.low, t.high, t.turns,
                   [c and c[0] for c in cells], [c and c[1] for c in cells])
        yield from _grouped(batches, part_cols, 2, work)

    def spark_schema(fields):
        return (fields.replace(" conv,", f" {conv},").replace("costs costs", "costs array<bigint>")
                .replace("audits audits", "audits array<string>"))

    cells = slim.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    cells = cells.mapInArrow(parts, spark_schema(part_cols))
    whole_cols = f"conv_id conv, {COUNTS}"

    def wholes(batches):
        def work(key, mine):
            counts, gaps_low, high, n_turns, tail = [0] * 4, None, None, 0, None
            best = list(EMPTY[4 * START:4 * START + 4])
            for r in mine:
                counts = [a + b for a, b in zip(counts, r[2:6])]
                if r[6] is not None:
                    counts[3] += tail is not None and illegal(tail, r[6])
                    tail = r[7]
                if r[10]:
                    gaps_low = r[8] if gaps_low is None else gaps_low
                    n_turns += r[10] - (r[8] == high)
                    high = r[9]
                part = [None if c is None else (c, a) for c, a in zip(r[11], r[12])]
                best = list(combine([*best, *[None] * 12], part)[:4])
            cost, audit = min(best[q] for q in ACCEPT if best[q] is not None)
            yield (*key, high - gaps_low + 1 - n_turns if n_turns else 0, *counts, cost, audit)
        yield from _grouped(batches, whole_cols, 1, work)

    reports = cells.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(wholes, spark_schema(whole_cols))
    reports = staged(reports, "border-reports")
    # the report comes before the conversation's rows in one sorted stream
    none = [F.lit(None).cast("string").alias(c) for c in ("role", "text")]
    lead = reports.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), *none, *_COUNT_NAMES)
    body = rows.where("not gone").select("conv_id", "pos", "role", "text", *[
        F.lit(None).cast(reports.schema[c].dataType).alias(c) for c in _COUNT_NAMES])
    stream = lead.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def finish(batches):
        def work(key, mine):
            report = next(mine)
            fixed = repaired((r[2:4] for r in mine), report[-1])
            if turns:
                for i, pair in enumerate(fixed):
                    yield (*key, i, *pair)
            else:
                yield (*key, *report[4:], _digest(fixed))
        yield from _grouped(batches, out_cols, 1, work)

    return stream.mapInArrow(finish, spark_schema(out_cols))


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per
    conversation.  Rows whose ``gone_col`` is true count as missing, but their conversations stay."""
    return _parsed(_ordered(conversations, id_col, turn_col, role_col, text_col, gone_col), turns=False)


def repaired_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves, position from 0."""
    return _parsed(_ordered(conversations, id_col, turn_col, role_col, text_col, gone_col), turns=True)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of ``conv_id:turn`` mod 20."""
    rows = pick(conversations, ["conv_id", "turn", "role", "text"])
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("how", F.crc32(F.concat_ws(":", *part).cast("binary")) % 20)
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("how").isin(0, 1), "").when(F.col("how") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                       text.alias("text"), (F.col("how") == 0).alias("gone"), F.explode(times).alias("n")).drop("n")
