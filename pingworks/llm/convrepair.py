"""Conversation structure repair: generalised LR parsing of role sequences with edits.

A conversation's roles must read ``(s?(ua)+)?`` by their initials.  Its rows, in order, are
parsed by the LR automaton of that grammar on a graph-structured stack: every row may be
kept (K), given another role (R) or deleted (D), and turns may be inserted (I), each at a
cost; stacks share their tails, and paths that come to equal stacks merge into the one of
least (cost, audit).  No two paths of equal cost at one place can be prefixes of each other
(the longer one would hold more insertions), so merging keeps the least audit of all.

Spark first brings rows down to facts (initial, fault, copies), without texts.  Facts are
range-sorted by conversation and turn, so one conversation may lie in many tasks: each
parses its fragment from every stack that it could begin on, and the fragments' results
are then put together in order.  Texts are shuffled once, for the repaired turns.

Defined cases: null role or text is one space; null conv_id is a conversation like any
other; rows go by turn, null first, and within a turn by role and by the SHA-256 of the
text; equal rows of a turn are copies, all but the first duplicates; roles with other
initials than s, u, a, or none, can be given another role or deleted; very long texts are read whole
and never held beside each other (tested at 1 MB); other columns are left behind; an empty
table gives an empty result.  The SHA-256 of one repaired conversation takes its texts in
order, so those of one conversation pass through one task, row by row."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingworks.llm.shared import bound_batches, cut, parts_for

SPACES = " \t\n\x0b\x0c\r"
#: Rules of the role grammar; capitals are nonterminals.
GRAMMAR = (("C", ""), ("C", "T"), ("T", "sua"), ("T", "ua"), ("T", "Tua"))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a fragment; longer conversations are parsed in several.
FRAGMENT = 4096
ROLES = {"u": "user", "a": "assistant"}


def _closed(items: frozenset) -> frozenset:
    """An item set with the starts of all rules that it expects."""
    while True:
        wanted = {GRAMMAR[r][1][dot] for r, dot in items if dot < len(GRAMMAR[r][1])}
        more = items | {(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left in wanted}
        if more == items:
            return items
        items = frozenset(more)


def _goto(state: frozenset, x: str) -> frozenset:
    return _closed(frozenset((r, dot + 1) for r, dot in state if GRAMMAR[r][1][dot : dot + 1] == x))


def _shift(stack: tuple, x: str) -> tuple | None:
    """The stack after a role; what it completes is reduced at once."""
    state = _goto(stack[0], x)
    if not state:
        return None
    stack = (state, stack)
    while True:
        whole = [r for r, dot in stack[0] if dot == len(GRAMMAR[r][1]) and GRAMMAR[r][0] == "T"]
        if not whole:
            return stack
        left, right = GRAMMAR[whole[0]]
        for _ in right:
            stack = stack[1]
        stack = (_goto(stack[0], left), stack)


@dataclass(frozen=True)
class _Stacks:
    """All stacks between two rows, numbered from the empty one; the grammar recurs on
    the left only, so there are few."""

    after: list[dict[str, int]]
    done: list[int]


def _stacks() -> _Stacks:
    start = (_closed(frozenset((r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == "C")), None)
    number, after, todo = {start: 0}, [], [start]
    while todo:
        stack = todo.pop(0)
        row = {}
        for x in "sua":
            to = _shift(stack, x)
            if to is not None:
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[x] = number[to]
        after.append(row)
    whole = lambda state: any(GRAMMAR[r][0] == "C" and dot == len(GRAMMAR[r][1]) for r, dot in state)
    return _Stacks(after, [i for s, i in number.items() if whole(s[0])])


STACKS = _stacks()
_N = len(STACKS.after)
_MADE = [[row[x] for x in "ua" if x in row] for row in STACKS.after]
_KEPT = {x: [(i, row[x]) for i, row in enumerate(STACKS.after) if x in row] for x in "sua"}

Front = list  # by stack: (cost, audit) or None


def _merge(front: Front, i: int, cost: int, audit: str) -> bool:
    have = front[i]
    if have is None or cost < have[0] or (cost == have[0] and audit < have[1]):
        front[i] = (cost, audit)
        return True
    return False


def _inserted(front: Front) -> Front:
    more = True
    while more:
        more = False
        for i, way in enumerate(front):
            if way is not None:
                for j in _MADE[i]:
                    more |= _merge(front, j, way[0] + INSERT, way[1] + "I")
    return front


def _entering(i: int) -> Front:
    front: Front = [None] * _N
    front[i] = (0, "")
    return _inserted(front)


def _advance(front: Front, initial: str, fault: str, copies: int) -> Front:
    """The stacks after a row and its further copies, which are duplicates or blank."""
    out: Front = [None] * _N
    for i, way in enumerate(front):
        if way is not None:
            out[i] = (way[0] + DELETE, way[1] + "D")
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for i, j in _KEPT.get(initial, ()):
            if front[i] is not None:
                _merge(out, j, front[i][0] + KEEP + more, front[i][1] + "K")
        for i, way in enumerate(front):
            if way is not None:
                for j in _MADE[i]:
                    _merge(out, j, way[0] + REROLE + more, way[1] + "R")
    if copies > 1:
        out = [way and (way[0] + DELETE * (copies - 1), way[1] + "D" * (copies - 1)) for way in out]
    return _inserted(out)


def _fragment(rows: list[tuple], whole: bool) -> list[dict]:
    """Ways through ``rows``: from the empty stack only if they are a whole conversation."""
    ways = []
    for entry in [0] if whole else range(_N):
        front = _entering(entry)
        for _, initial, fault, copies in rows:
            front = _advance(front, initial, fault, copies)
        ways += [{"entry": entry, "exit": i, "cost": w[0], "audit": w[1]} for i, w in enumerate(front) if w is not None]
    return ways


def _tally(rows: list[tuple]) -> dict:
    """Counts of a fragment, and what the next one needs to know of its ends."""
    t = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "first": None, "last": None}
    for turn, initial, fault, n in rows:
        if fault:
            t[fault] += 1
        t["blank" if fault == "blank" else "duplicate"] += n - 1
        t["illegal"] += n - 1 + (t["last"] is not None and t["last"] + initial not in ("su", "ua", "au"))
        t["first"] = initial if t["first"] is None else t["first"]
        t["last"] = initial
        if turn is not None and turn != t["high"]:
            t["turns"] += 1
            t["low"] = turn if t["low"] is None else t["low"]
            t["high"] = turn
    return t


_COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_WAYS = "ways array<struct<entry:int,exit:int,cost:long,audit:string>>"
_WAYS_ARROW = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_COUNTS_ARROW = [(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _COUNTS.split(", ")]


def _schema(key: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string(rest).fields])


def facts(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, digest, fault, copies): equal rows of a turn as one, without
    their texts.  ``ids`` adds conversations without rows."""
    spark = rows.sparkSession
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    solid = F.rtrim(text, F.lit(SPACES))
    fault = F.when(solid == "", "blank").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), fault.alias("fault"))
    out = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("copies"))
    if ids is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in out.dtypes if c not in ("conv_id", "copies")]
        out = out.unionByName(ids.select("conv_id").distinct().select("conv_id", *none, F.lit(0).cast("long").alias("copies")))
    out = cut(out, "turn-facts")
    # texts that a conversation has in several turns: all but the first are duplicates
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = out.filter("copies > 0 and (fault is null or fault <> 'blank')").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select(F.col("conv_id").alias("a_conv"), F.col("role").alias("a_role"), F.col("digest").alias("a_digest"), "first")
    # blank rows are never duplicates and so never look for a first one
    look = F.when(~F.coalesce(F.col("fault") == "blank", F.lit(False)), F.col("digest"))
    joined = out.join(again, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) & (look == F.col("a_digest")), "left")
    fault = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place), "duplicate").otherwise(F.col("fault"))
    return cut(joined.select("conv_id", "turn", "role", "digest", fault.alias("fault"), "copies"), "turn-faults")


def fragments(found: DataFrame, longest: int = FRAGMENT) -> DataFrame:
    """`facts` to parsed fragments, a row each: (conv_id, part, seq, whole, counts, ways)."""
    key = found.schema["conv_id"].dataType
    names = ["conv_id", "part", "seq", "whole", *[n for n, _ in _COUNTS_ARROW], "ways"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, rows, kind = TaskContext.get().partitionId(), 0, None, [], None
        inside, split, any_yet = False, False, False  # began in this task; cut before; some row came

        def put(whole: bool) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            t = _tally(rows)
            cols = [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([whole], pa.bool_())]
            cols += [pa.array([t[n]], k) for n, k in _COUNTS_ARROW] + [pa.array([_fragment(rows, whole)], _WAYS_ARROW)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for c, turn, initial, fault, n in zip(*[x.to_pylist() for x in b.columns]):
                if not any_yet or c != conv:
                    if any_yet:
                        yield put(inside and not split)
                    conv, inside, split, any_yet = c, any_yet, False, True
                elif len(rows) == longest:
                    yield put(False)
                    split = True
                if n:
                    rows.append((turn, initial, fault or "", n))
        if any_yet:
            yield put(False)

    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    order = ["conv_id", "turn", "role", "digest"]
    parts = parts_for(found.agg(F.count(F.lit(1)) * 64))
    rows = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", initial.alias("initial"), "fault", "copies")
    return rows.mapInArrow(run, _schema(key, f"part int, seq long, whole boolean, {_COUNTS}, {_WAYS}"))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Whole:
    """Fragments of one conversation, put together in order."""

    def __init__(self) -> None:
        self.front, self.prefix, self.last = _entering(0), [], None
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = None

    def add(self, f: dict) -> None:
        out: Front = [None] * _N
        for w in f["ways"]:
            have = self.front[w["entry"]]
            if have is not None:
                _merge(out, w["exit"], have[0] + w["cost"], have[1] + w["audit"])
        same = os.path.commonprefix([w[1] for w in out if w is not None])
        self.prefix.append(same)
        self.front = [w and (w[0], w[1][len(same) :]) for w in out]
        for k in self.sums:
            self.sums[k] += f[k]
        if self.last is not None and f["first"] is not None:
            self.sums["illegal"] += self.last + f["first"] not in ("su", "ua", "au")
        self.last = f["last"] or self.last
        if f["low"] is not None:
            self.sums["turns"] -= f["low"] == self.high
            self.low = f["low"] if self.low is None else self.low
            self.high = f["high"]

    def result(self) -> tuple:
        cost, audit = min(self.front[i] for i in STACKS.done if self.front[i] is not None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return gaps, *[self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")], cost, "".join(self.prefix) + audit


def audits(rows: DataFrame, ids: DataFrame | None = None, longest: int = FRAGMENT) -> DataFrame:
    """A row a conversation: gaps, faults, illegal neighbours, cost and audit of the
    cheapest repair; ``longest`` is how many rows are parsed in one piece."""
    spark = rows.sparkSession
    bound_batches(spark)
    found = facts(rows, ids)
    parts = cut(fragments(found, longest), "fragments")
    key = found.schema["conv_id"].dataType
    arrow = [(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, whole = None, None
        for b in batches:
            kind, convs, out = b.schema.field(0).type, [], []
            for f in b.to_pylist():
                if whole is None or f["conv_id"] != conv:
                    if whole is not None:
                        convs.append(conv)
                        out.append(whole.result())
                    conv, whole = f["conv_id"], _Whole()
                whole.add(f)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind), *[pa.array(v, k) for v, (_, k) in zip(zip(*out), arrow)]], names=["conv_id", *[n for n, _ in arrow]])
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), *[pa.array([v], k) for v, (_, k) in zip(whole.result(), arrow)]], names=["conv_id", *[n for n, _ in arrow]])

    schema = _schema(key, _RESULT)
    # whole conversations stay where they are; the others' fragments meet, in order
    return parts.filter("whole").mapInArrow(run, schema).unionByName(
        parts.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)
    )


class _Repaired:
    """Turns of one conversation as its audit has them, one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.last = audit, 0, ""

    def _made(self) -> str:
        self.last = "a" if self.last == "u" else "u"
        return ROLES[self.last]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        what = self.audit[self.at]
        self.at += 1
        if what == "K":
            self.last = role[0]
            yield role, text
        elif what == "R":
            yield self._made(), text


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audit rows, each before the rows of its conversation in order."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    own = [c for c in found.columns if c != "conv_id"]
    turns = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), *own)
    both = heads.unionByName(turns, allowMissingColumns=True)
    total = rows.agg(F.sum(F.octet_length("text").cast("long")))
    order = ["conv_id", "kind", "turn", "role", "digest"]
    return both.repartition(parts_for(total), "conv_id").sortWithinPartitions(*order).select("conv_id", "kind", *own, "role", "text")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`audits` with repaired_sha256, of the repaired ``role:text`` joined by newlines."""
    key, own = found.schema["conv_id"].dataType, [c for c in found.columns if c != "conv_id"]
    schema = T.StructType([*found.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, turns, sha, some = None, None, None, False

        def take(items: Iterator[tuple[str, str]]) -> None:
            nonlocal some
            for role, text in items:
                sha.update(("\n" * some + role + ":" + text).encode("utf-8", "surrogatepass"))
                some = True

        def close() -> dict:
            take(turns.inserted())
            return head | {"repaired_sha256": sha.hexdigest()}

        for b in batches:
            out = []
            cols = {c: b.column(c) for c in b.schema.names}
            shape = pa.schema([*[b.schema.field(c) for c in ("conv_id", *own)], ("repaired_sha256", pa.string())])
            for i, (kind, role) in enumerate(zip(cols["kind"].to_pylist(), cols["role"].to_pylist())):
                if kind == 0:
                    if head is not None:
                        out.append(close())
                    head = {c: cols[c][i].as_py() for c in ("conv_id", *own)}
                    turns, sha, some = _Repaired(head["audit"]), hashlib.sha256(), False
                else:
                    take(turns.row(role, cols["text"][i].as_py()))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
        if head is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=shape)

    return _stream(rows, found).mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, position from 0."""
    found = cut(audits(rows), "audits").select("conv_id", "audit")
    schema = _schema(rows.schema["conv_id"].dataType, "position long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, at = None, None, 0
        for b in batches:
            kind_of, out = b.schema.field("conv_id").type, []
            for i, (c, kind, audit, role) in enumerate(zip(*[b.column(x).to_pylist() for x in ("conv_id", "kind", "audit", "role")])):
                if kind == 0:
                    if turns is not None:
                        out += [(conv, at + k, *x) for k, x in enumerate(turns.inserted())]
                    conv, turns, at = c, _Repaired(audit), 0
                else:
                    new = list(turns.row(role, b.column("text")[i].as_py()))
                    out += [(conv, at + k, *x) for k, x in enumerate(new)]
                    at += len(new)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (kind_of, pa.int64(), pa.string(), pa.string()))], names=schema.names)
        if turns is not None:
            out = [(conv, at + k, *x) for k, x in enumerate(turns.inserted())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (kind_of, pa.int64(), pa.string(), pa.string()))], names=schema.names)

    return _stream(rows, found).mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations with rows dropped, emptied, cut, repeated or given the user's
    role, by the CRC-32 of ``conv_id:turn``."""
    one = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(one(F.col("conv_id")), F.lit(":"), one(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one(F.col("role")).alias("role"), one(F.col("text")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__copy")).drop("__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hurt = damage(rows)
    return digests(hurt, cut(audits(hurt, rows.select("conv_id")), "audits"))


def _way(w: str, cost: int | str, letter: str) -> str:
    """A way (cost in eight digits, then audit) one edit on; null stays null."""
    return f"(lpad(CAST(CAST({w}[1:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || {w}[9:] || '{letter}')"


def _least(*x: str) -> str:
    return f"least({', '.join(x)})"


_FIRST = f"'00000000' AS c0, CAST(NULL AS VARCHAR) AS c1, {_way('''CAST('00000000' AS VARCHAR)''', INSERT, 'I')} AS c2, '00000006II' AS c3"
_ANY = ("c0", "c1", "c3")
_MORE = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"


def _if(cond: str, x: str) -> str:
    return f"CASE WHEN {cond} THEN {x} END"


_OPEN = "fault NOT IN ('blank', 'duplicate')"

ORACLE_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc
  FROM conversations
), kinds AS (
  SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM src
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds CROSS JOIN (VALUES (0), (1)) AS r(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM hurt
), rows_ AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'x' END AS sym
  FROM placed
), convs AS (
  SELECT DISTINCT conv_id FROM conversations
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, {_FIRST} FROM convs
  UNION ALL
  SELECT conv_id, i, c0, c1, d2 AS c2, {_least("d3", _way("d2", INSERT, "I"))} AS c3 FROM (
    SELECT conv_id, i, n0 AS c0, n1 AS c1, {_least("n2", *[_way(f"n{k}", INSERT, "I") for k in (0, 1, 3)])} AS d2, n3 AS d3 FROM (
      SELECT w.conv_id, r.i, {_way("c0", DELETE, "D")} AS n0,
        {_least(_way("c1", DELETE, "D"), _if(f"{_OPEN} AND sym = 's'", _way("c0", _MORE, "K")))} AS n1,
        {_least(_way("c2", DELETE, "D"), *[_if(f"{_OPEN} AND sym = 'u'", _way(c, _MORE, "K")) for c in _ANY], *[_if(_OPEN, _way(c, f"{REROLE} + {_MORE}", "R")) for c in _ANY])} AS n2,
        {_least(_way("c3", DELETE, "D"), _if(f"{_OPEN} AND sym = 'a'", _way("c2", _MORE, "K")), _if(_OPEN, _way("c2", f"{REROLE} + {_MORE}", "R")))} AS n3
      FROM walk w JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1)))
, best AS (
  SELECT conv_id, {_least("c0", "c3")} AS way FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), audits AS (
  SELECT conv_id, CAST(way[1:8] AS BIGINT) AS cost, way[9:] AS audit FROM best
), letters AS (
  SELECT conv_id, k, audit[k:k] AS what, len(replace(audit[1:k], 'I', '')) AS i, len(replace(audit[1:k], 'D', '')) AS p
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM audits)
), kept AS (
  SELECT l.*, r.role, r.text, max(CASE WHEN l.p = 1 AND l.what = 'K' AND r.sym = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS shifted
  FROM letters l LEFT JOIN rows_ r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND l.i = r.i AND l.what <> 'I' WHERE l.what <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN what = 'K' THEN role WHEN (p - shifted) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN what = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body
  FROM kept GROUP BY conv_id
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || sym NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(sym) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_) GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM audits a LEFT JOIN stats s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN texts t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""
