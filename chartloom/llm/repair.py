"""Conversation structure repair by depth-first branch and bound.

A conversation should be one optional system message, then pairs of user and assistant: role initials
``(s?(ua)+)?``. Its rows are kept (cost 0), given the role user or assistant (1) or deleted (2), and an empty message of user
or assistant may be inserted anywhere (5). Blank rows and repeated ones (role and text seen earlier in the
conversation) have to be deleted; a truncated row that stays costs 5 more. Of all ways the cheapest is taken, and of equally
cheap ones that whose *audit* (the initials K, R, D, I of its edits in order) is least in ASCII.

``solve`` searches depth first over an explicit stack of prefixes (rows done, last role, cost, audit):

* *suffix lower bounds*: what the rows still to come cost at least, for a conversation that may stop after any message;
* *incumbent*: the best whole (cost, audit) so far; a prefix that can't beat it, in cost or by audit at equal cost, is cut;
* *dominance*: the best (cost, audit) seen for each node (rows done, last role). Of two prefixes of one node the worse can't
  win: at equal cost neither audit begins the other, because what one has more would be insertions, which cost.

The search ends when the stack is empty, which proves the incumbent.

Spread. Rows travel without their texts first: repeated rows are found by SHA-256 over role and text (a minimum
per conversation and digest, joined back), equal rows of one turn are one row with a count. Rows are then dealt
by *ranges* of (conversation, turn), so a conversation of any size is cut over tasks, and within a task after ``SEGMENT`` rows.
A segment that is not a whole conversation is solved for each first and last role; the tables of its segments are
put together in order, 16 audits per ``SEGMENT`` rows. Texts are moved once, for the repaired messages: they stream
in order past the audit of their conversation, and nothing but the audit is held.

Cases: a null role or text is read as one space; null turns come first; rows of one turn are ordered by the digest of
role and text; rows with a null conversation id are one conversation; a role with another initial than s, u or a (or none)
can't be kept; conversations without rows have empty audits and the cost 0; an empty table gives an empty result; further
columns are ignored. Long texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from chartloom.llm.checks import crc32
from chartloom.llm.tables import stored

RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows that are searched at once.
SEGMENT = 512
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow each last role.
FOLLOWS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A row is its role (0: none that can be kept) plus 4 if it is truncated, 8 if it must go.
CUT, GONE = 4, 8


def _steps(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, last role) of the edits of a row after a last role."""
    steps = [("D", DELETE, state)]
    if not code & GONE:
        extra = TRUNCATED if code & CUT else 0
        for then in FOLLOWS[state]:
            if code & 3 == then:
                steps.append(("K", extra, then))
            elif then != SYSTEM:
                steps.append(("R", RETITLE + extra, then))
    return steps


def suffix_bounds(codes: bytes) -> list[tuple[int, ...]]:
    """For each number of rows done and last role: the least cost of the rest if it may stop after any message."""
    bounds = [(0, 0, 0, 0)]
    for code in reversed(codes):
        after = bounds[-1]
        plain = [min(cost + after[then] for _, cost, then in _steps(code, state)) for state in range(4)]
        bounds.append(tuple(min([plain[state], *(INSERT + plain[then] for then in FOLLOWS[state] if then != SYSTEM)]) for state in range(4)))
    return bounds[::-1]


@lru_cache(1 << 15)
def solve(codes: bytes, entry: int = START, goals: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from the last role ``entry`` over all rows to one of ``goals``."""
    n, bounds = len(codes), suffix_bounds(codes)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        done, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bounds[done][state]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        if seen.get((done, state), (cost + 1,)) <= (cost, audit):
            continue
        seen[done, state] = (cost, audit)
        if done == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        ways = [(done, "I", INSERT, then) for then in FOLLOWS[state] if then != SYSTEM]
        if done < n:
            ways += [(done + 1, *step) for step in _steps(codes[done], state)]
        ways = [(cost + more + bounds[k][then], letter, k, then, cost + more) for k, letter, more, then in ways]
        stack += [(k, then, paid, audit + letter) for _, letter, k, then, paid in sorted(ways, reverse=True)]
    return best


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


#: What a segment tells about its rows; audits by (first role, last role), or one for a whole conversation.
_SEGMENT = (
    "seq long, initial string, final string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "whole boolean, table array<struct<entry:int,goal:int,cost:long,audit:string>>"
)


class _Run:
    """The rows of one segment while they pass."""

    def __init__(self, certain: bool):
        self.codes, self.certain = bytearray(), certain
        self.initial = self.final = None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, role: str, turn: int | None, blank: bool, repeated: bool, cut: bool) -> None:
        kind = "blank" if blank else "duplicate" if repeated else "truncated" if cut else None
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)
        self.codes.append(_INITIAL.get(role, 0) | (GONE if blank or repeated else CUT if cut else 0))
        if self.initial is None:
            self.initial = role
        else:
            self.illegal += not _legal(self.final, role)
        self.final = role
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def told(self, conv, seq: int, ends: bool) -> list:  # noqa: ANN001
        codes, whole = bytes(self.codes), self.certain and ends
        asked = [(START, (START, ASSISTANT))] if whole else [(e, (g,)) for e in range(4) for g in range(4)]
        table = [{"entry": e, "goal": g[0], "cost": found[0], "audit": found[1]} for e, g in asked if (found := solve(codes, e, g))]
        return [conv, seq, self.initial, self.final, self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, whole, table]


def _batched(rows: Iterator[list], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[list] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _segments(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role initial, blank, cut, repeated, n) in order of conversation and turn, as solved segments."""
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, {_SEGMENT}"
    arrow = _arrow(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40

        def told() -> Iterator[list]:
            now, conv, seq = None, None, task
            for this, turn, role, blank, cut, repeated, n in _rows(batches):
                if now is None or this != conv:
                    if now is not None:
                        yield now.told(conv, seq, True)
                    # the first run of a task may go on from the task before
                    now, conv, seq = _Run(certain=now is not None), this, seq + 1
                for k in range(n):
                    if len(now.codes) == SEGMENT:
                        yield now.told(conv, seq, False)
                        now, seq = _Run(certain=False), seq + 1
                    now.add(role, turn, blank, repeated or k > 0, cut)
            if now is not None:
                yield now.told(conv, seq, False)

        yield from _batched(told(), arrow)

    ordered = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("digest")]
    dealt = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return dealt.select("conv", "turn", "initial", "blank", "cut", "repeated", "n").mapInArrow(run, schema)


def _arrow(spark, schema: str) -> pa.Schema:  # noqa: ANN001
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


_HEADER = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(segments: DataFrame) -> DataFrame:
    """Segments of each conversation put together in order: measures, cost and audit."""
    schema = f"conv {segments.schema['conv'].dataType.simpleString()}, {_HEADER}"
    arrow = _arrow(segments.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[list]:
            conv, now = None, None

            def done() -> list:
                gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                cost, audit = min(v for k, v in now["best"].items() if k in (START, ASSISTANT))
                return [conv, gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit]

            for this, _, initial, final, low, high, turns, blank, duplicate, truncated, illegal, _, table in _rows(batches):
                if now is None or this != conv:
                    if now is not None:
                        yield done()
                    conv = this
                    now = {"best": {START: (0, "")}, "low": None, "high": None, "final": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                best: dict[int, tuple[int, str]] = {}
                for way in table:
                    if way["entry"] in now["best"]:
                        cost, audit = now["best"][way["entry"]]
                        got = (cost + way["cost"], audit + way["audit"])
                        best[way["goal"]] = min(got, best.get(way["goal"], got))
                now["best"] = best
                now["illegal"] += illegal + (now["final"] is not None and not _legal(now["final"], initial))
                now["final"] = final
                if low is not None:
                    now["turns"] += turns - (low == now["high"])
                    now["low"] = low if now["low"] is None else now["low"]
                    now["high"] = high
                for name, n in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
                    now[name] += n
            if now is not None:
                yield done()

        yield from _batched(told(), arrow)

    return segments.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "seq").mapInArrow(run, schema)


def _lines(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    lines = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    return lines.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def audits(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: gaps among its turns, blank, duplicate and truncated rows (each by its first fault), neighbours with
    an illegal pair of roles, and the cost and audit of the cheapest repair."""
    has = lambda pattern: F.col("text").rlike(pattern)
    codes = _lines(rows, conv_id, turn, role, text).select(
        "conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (~has(r"[^\x20\x09-\x0D]")).alias("blank"), (~has(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")
    )
    alike = stored(codes.groupBy("conv", "turn", "digest", "initial", "blank", "cut").agg(F.count(F.lit(1)).alias("n")), "alike")
    first = alike.groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("at"))
    found = alike.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    found = found.select("conv", "turn", "digest", "initial", "blank", "cut", (~F.col("turn").eqNullSafe(F.col("at.turn"))).alias("repeated"), "n")
    return _joined(_segments(stored(found, "flagged"))).withColumnRenamed("conv", conv_id)


def _streamed(rows: DataFrame, found: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations one after the other: its id, then its audit, then its rows in order."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lines = _lines(rows, conv_id, turn, role, text).withColumn("kind", F.lit(1))
    heads = found.select(F.col(conv_id).alias("conv"), F.lit(0).alias("kind"), *names)
    both = heads.unionByName(lines, allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "kind", F.asc_nulls_first("turn"), "digest")
    return both.select("conv", "kind", *names, "turn", "role", "text")


class _Writer:
    """Repaired messages of a conversation, as its rows come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _role(self) -> str:
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", None, self._role(), ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _INITIAL[role[:1]]
            yield edit, turn, role, text
        elif edit == "R":
            yield edit, turn, self._role(), text


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the messages of the repaired conversations, in order from place 0.

    ``edit`` is K, R or I; an inserted message has no turn and an empty text.
    """
    source = _streamed(rows, audits(rows, conv_id, turn, role, text), conv_id, turn, role, text)
    schema = f"{conv_id} {rows.schema[conv_id].dataType.simpleString()}, place long, edit string, turn long, role string, text string"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[list]:
            place, now, writer = 0, None, None
            for conv, kind, *head, at, who, what in _rows(batches):
                if kind == 0:
                    if writer:
                        for k, message in enumerate(writer.inserted(), place):
                            yield [now, k, *message]
                    place, now, writer = 0, conv, _Writer(head[-1])
                else:
                    for message in writer.row(at, who, what):
                        yield [now, place, *message]
                        place += 1
            if writer:
                for k, message in enumerate(writer.inserted(), place):
                    yield [now, k, *message]

        yield from _batched(told(), arrow, 256)

    return source.mapInArrow(run, schema)


def digested(rows: DataFrame, original: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation of ``original`` the measures, cost and audit of its ``rows``, and the SHA-256 of the
    repaired messages as ``role:text`` lines."""
    found = audits(rows, conv_id, turn, role, text)
    source = _streamed(rows, found, conv_id, turn, role, text)
    schema = f"{conv_id} {rows.schema[conv_id].dataType.simpleString()}, {_HEADER}, repaired_sha256 string"
    arrow = _arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[list]:
            now, writer, sha, empty = None, None, None, True

            def add(messages: Iterator[tuple]) -> None:
                nonlocal empty
                for _, _, who, what in messages:
                    sha.update(f"{'' if empty else chr(10)}{who}:{what}".encode())
                    empty = False

            for conv, kind, *head, at, who, what in _rows(batches):
                if kind == 0:
                    if writer:
                        add(writer.inserted())
                        yield [*now, sha.hexdigest()]
                    now, writer, sha, empty = [conv, *head], _Writer(head[-1]), hashlib.sha256(), True
                else:
                    add(writer.row(at, who, what))
            if writer:
                add(writer.inserted())
                yield [*now, sha.hexdigest()]

        yield from _batched(told(), arrow)

    hashed = source.mapInArrow(run, schema)
    every = original.select(F.col(conv_id).alias("_c")).distinct()
    out = every.join(hashed, F.col("_c").eqNullSafe(F.col(conv_id)), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_c").alias(conv_id), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` modulo 20 gives them; nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    pick = lambda n, then, other: F.when(F.col("_fault") == n, then).otherwise(other)
    hit = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text: Column = pick(1, F.lit(""), pick(2, F.regexp_replace("text", "[.!?]", ""), F.col("text")))
    hit = hit.select("conv_id", "turn", pick(4, F.lit("user"), F.col("role")).alias("role"), text.alias("text"), "_fault")
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def _paid(value: str, cost: str, letter: str) -> str:
    """A state is its cost in twelve digits and its audit."""
    return f"format('{{:012d}}', cast(left({value}, 12) as bigint) + {cost}) || substr({value}, 13) || '{letter}'"


def _open(source: str) -> str:
    """The states once a message may have been inserted."""
    return f"(select conv, i, v0, v1, least(v2, {_paid('least(v0, v1, v3)', '5', 'I')}) as v2, least(v3, {_paid('v2', '5', 'I')}) as v3 from {source})"


_STEP = f"""select r.conv, r.i, {_paid("w.v0", "2", "D")},
  least({_paid("w.v1", "2", "D")}, case when ok and r.initial = 's' then {_paid("w.v0", "pay", "K")} end),
  least({_paid("w.v2", "2", "D")}, case when ok and r.initial = 'u' then {_paid("least(w.v0, w.v1, w.v3)", "pay", "K")} when ok then {_paid("least(w.v0, w.v1, w.v3)", "pay + 1", "R")} end),
  least({_paid("w.v3", "2", "D")}, case when ok and r.initial = 'a' then {_paid("w.v2", "pay", "K")} when ok then {_paid("w.v2", "pay + 1", "R")} end)
  from {_open("states")} w join numbered r on r.conv is not distinct from w.conv and r.i = w.i + 1"""

SQL = rf"""
with recursive given as (select conv_id as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
faults as (select *, {crc32("k")} % 20 as f from given),
hit as (select conv, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when f = 3 then 2 else 1 end)) as copy from faults where f <> 0),
ordered as (select conv, turn, role, text, row_number() over (partition by conv order by turn nulls first, sha256(cast(length(role) as varchar) || ':' || role || text)) as i from hit),
judged as (select *, left(role, 1) as initial, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv, role, text order by i) > 1 as again,
  not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut, lag(left(role, 1)) over (partition by conv order by i) as before from ordered),
numbered as (select conv, i, initial, not blank and not again as ok, case when cut then 5 else 0 end as pay from judged),
states as (select conv, cast(0 as bigint) as i, '000000000000' as v0, cast(null as varchar) as v1, cast(null as varchar) as v2, cast(null as varchar) as v3 from (select distinct conv from judged)
  union all {_STEP}),
last as (select s.* from states s join (select conv, max(i) as n from judged group by conv) m on s.conv is not distinct from m.conv and s.i = m.n),
solved as (select conv, least(v0, v3) as v from {_open("last")}),
letters as (select conv, p, substr(v, 12 + p, 1) as e, v from (select conv, v, unnest(range(1, length(v) - 11)) as p from solved)),
edits as (select conv, p, e, sum(case when e <> 'I' then 1 else 0 end) over w as i, sum(case when e <> 'D' then 1 else 0 end) over w as q from letters window w as (partition by conv order by p)),
heads as (select x.conv, max(case when x.q = 1 and x.e = 'K' and j.initial = 's' then 1 else 0 end) as s from edits x left join judged j on j.conv is not distinct from x.conv and j.i = x.i group by x.conv),
lines as (select x.conv, x.p, (case when x.e = 'K' then j.role when (x.q - h.s) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when x.e = 'I' then '' else j.text end) as line
  from edits x join heads h on h.conv is not distinct from x.conv left join judged j on j.conv is not distinct from x.conv and j.i = x.i where x.e <> 'D'),
hashed as (select conv, sha256(string_agg(line, chr(10) order by p)) as h from lines group by conv),
counts as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
  count(*) filter (cut and not again and not blank) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from judged group by conv)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(left(v, 12) as bigint), 0) as cost, coalesce(substr(v, 13), '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts on counts.conv is not distinct from o.conv_id
  left join solved on solved.conv is not distinct from o.conv_id left join hashed on hashed.conv is not distinct from o.conv_id
"""
