"""Conversation structure repair: generalised LR parsing with weighted edits.

The roles of a conversation, in order, should be a sentence of a small grammar.
From the grammar come LR(0) tables; stacks are nodes of a graph that share
their lower parts, and equal stack tops over the same rest are one node. Rows
are read one by one: each may be kept, given another role or deleted, and rows
may be inserted between them. Of all edits that lead to one node the least
(cost, audit) stays, audit being the initials of the edits.

Rows are put in order by a range shuffle, so a conversation of any length is
spread over tasks. A run is at most RUN rows of one conversation. What lies
whole within a task is repaired there. Runs of other conversations become
tables (node before -> node behind: cost, audit), which are joined up in order.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The grammar of role initials, what edits cost, and the roles that may be given or inserted.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
RUN, RUN_BYTES = 256, 1 << 22
MOST_NODES = 64


class Stacks:
    """LR(0) tables of a grammar (its first rule's left side is the start), and the graph of stacks that they lead to."""

    def __init__(self, grammar: tuple = GRAMMAR):
        self.rules = (("", grammar[0][0]), *grammar)
        self.symbols = {a for a, _ in grammar}
        self.tokens = sorted({c for _, b in grammar for c in b} - self.symbols)
        self.root = (self._closed({(0, 0)}), None)
        self.nodes, self.shift = [self.root], []
        for node in self.nodes:  # grows on the way
            self.shift.append({})
            for t in self.tokens:
                to = self._settled((self._goto(node[0], t), node)) if self._goto(node[0], t) else []
                for x in to:
                    if x not in self.nodes:
                        self.nodes.append(x)
                self.shift[-1][t] = [self.nodes.index(x) for x in to]
            if len(self.nodes) > MOST_NODES:
                raise ValueError("the grammar's stacks grow without bound: write its repetitions left-recursively")
        self.accepting = [self._accepts(x) for x in self.nodes]

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            if dot < len(right) and right[dot] in self.symbols:
                new = {(i, 0) for i, (left, _) in enumerate(self.rules) if i and left == right[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    @functools.cache
    def _goto(self, state: frozenset, symbol: str) -> frozenset:
        return self._closed({(r, d + 1) for r, d in state if self.rules[r][1][d : d + 1] == symbol})

    def _reduced(self, node: tuple) -> list[tuple]:
        out = []
        for r, d in node[0]:
            left, right = self.rules[r]
            if r and d == len(right):
                below = node
                for _ in right:
                    below = below[1]
                out.append((self._goto(below[0], left), below))
        return out

    def _settled(self, node: tuple) -> list[tuple]:
        """The stacks that a stack may be before the next shift: those that can shift, of itself and all that reductions make of it."""
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x not in out and any(self._goto(x[0], t) for t in self.tokens):
                out.append(x)
            todo += self._reduced(x)
        return out if not self._accepts(node) or any(map(self._accepts, out)) else [*out, node]

    def _accepts(self, node: tuple) -> bool:
        return (0, 1) in node[0] or any(map(self._accepts, self._reduced(node)))


@functools.cache
def stacks() -> Stacks:
    return Stacks()


def better(front: dict, node: int, value: tuple[int, str]) -> bool:
    """Puts value at node unless what is there is less."""
    if node in front and front[node] <= value:
        return False
    front[node] = value
    return True


def with_inserts(front: dict) -> dict:
    """front (node -> (cost, audit)) and what insertions make of it; each costs more, so this ends."""
    shift, todo = stacks().shift, list(front)
    while todo:
        x = todo.pop()
        cost, audit = front[x]
        for t in GIVEN:
            todo += [y for y in shift[x][t] if better(front, y, (cost + INSERT, audit + "I"))]
    return front


def read(front: dict, initial: str, fault: str) -> dict:
    """The front behind one more row."""
    shift, out = stacks().shift, {}
    late = TRUNCATED if fault == "t" else 0
    for x, (cost, audit) in with_inserts(front).items():
        better(out, x, (cost + DELETE, audit + "D"))
        if fault in "bd" and fault:
            continue
        for y in shift[x].get(initial, ()):
            better(out, y, (cost + late, audit + "K"))
        for t in GIVEN:
            for y in shift[x][t]:
                better(out, y, (cost + REROLE + late, audit + "R"))
    return out


def ended(front: dict) -> tuple[int, str]:
    """The least (cost, audit) of all stacks that are a sentence.

    Two ways to one node of equal cost read equally many rows, so neither audit
    begins the other and the lesser one stays the lesser with any continuation.
    """
    ok = stacks().accepting
    return min(v for x, v in with_inserts(front).items() if ok[x])


@functools.lru_cache(maxsize=1 << 14)
def edits(shape: tuple) -> tuple[int, str]:
    """(cost, audit) of a conversation's (initial, fault)s."""
    front = {0: (0, "")}
    for initial, fault in shape:
        front = read(front, initial, fault)
    return ended(front)


@functools.lru_cache(maxsize=1 << 10)
def table(shape: tuple) -> str:
    """A run as JSON: for every node before it, the nodes behind it and their (cost, audit)."""
    out = []
    for start in range(len(stacks().nodes)):
        front = {start: (0, "")}
        for initial, fault in shape:
            front = read(front, initial, fault)
        out.append(front)
    return json.dumps(out)


def faults(roles: list[str], texts: list[str], again: list[bool]) -> list[str]:
    """The first fault of each row: b blank, d duplicate, t truncated, or none."""
    out = []
    for text, seen in zip(texts, again):
        last = next((c for c in reversed(text) if VISIBLE.match(c)), None)
        out.append("b" if last is None else "d" if seen else "" if last in ".!?" else "t")
    return out


def replay(audit: str, roles: list[str], texts: list[str], due: str = "u") -> tuple[list[str], list[str], str]:
    """The rows that edits leave, and the role due next. A sentence's role is known by its place: only a kept first `s` isn't u or a in turn."""
    out_roles, out_texts, at = [], [], 0
    for c in audit:
        if c != "D":
            role = roles[at] if c == "K" else GIVEN[due]
            out_roles.append(role)
            out_texts.append("" if c == "I" else texts[at])
            if role[:1] in GIVEN:
                due = "a" if role[:1] == "u" else "u"
        at += c != "I"
    return out_roles, out_texts, due


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live of conversations with seeded faults.

    By crc32 of `conv_id:turn` modulo 20 a row is dropped (0: it stays as one
    that isn't live, so that its conversation is known), emptied (1), loses its
    full stops (2), is repeated (3) or is given to the user (4). Nulls read as
    one space; turn and conv_id stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("h_"))
    h = F.col("h_")
    role = F.when(h == 0, "").when(h == 4, "user").otherwise(F.col("role"))
    text = F.when(h < 2, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(h == 3, 2).otherwise(1)))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h != 0).alias("live"), copies.alias("c_")).drop("c_")


RUN_COLUMNS = "part int, no int, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _counts(roles: list[str], found: list[str], before: str | None = None) -> list[int]:
    initials = ([before] if before is not None else []) + [r[:1] for r in roles]
    return [found.count("b"), found.count("d"), found.count("t"), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _arrow(schema: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([("conv_id", conv), *((n, kinds[k]) for n, k in (x.split() for x in schema.split(", ")))])


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of ordered rows: those of conversations that lie whole in one task are repaired, others (whole: false) are as they came."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held, conv, no, first, begun, out, size, schema = [], None, 0, True, False, [], 0, None

        def close(edge: bool):
            nonlocal held, no, size
            live = [r for r in held if r[3]]
            turns = [r[0] for r in live if r[0] is not None]
            roles, texts = [r[1] for r in live], [r[2] for r in live]
            stats = (min(turns, default=None), max(turns, default=None), len(set(turns)))
            if edge or no:
                out.append((conv, part, no, False, *stats, 0, 0, 0, 0, 0, "", roles, texts))
            else:
                seen: set = set()
                again = [(k in seen) or seen.add(k) or False for k in zip(roles, texts)]
                found = faults(roles, texts, again)
                cost, audit = edits(tuple((r[:1], f) for r, f in zip(roles, found)))
                out.append((conv, part, no, True, *stats, *_counts(roles, found), cost, audit, *replay(audit, roles, texts)[:2]))
            held, no, size = [], no + 1, 0

        for batch in batches:
            schema = schema or _arrow(RUN_COLUMNS, batch.schema.field("conv_id").type)
            for c, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if begun and c != conv:
                    if held:
                        close(first)
                    no, first = 0, False
                conv, begun = c, True
                held.append(row)
                size += len(row[2])
                if len(held) == RUN or size > RUN_BYTES:
                    # more of the conversation may follow, so it isn't known to be whole
                    close(True)
            if out:
                yield _batch(out, schema)
                out.clear()
        if held:
            close(True)
        if out:
            yield _batch(out, schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    ordered = rows.select("conv_id", "turn", "role", "text", "live").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"conv_id {kind}, {RUN_COLUMNS}")


def _again(runs: DataFrame) -> DataFrame:
    """runs with `again`: which of a run's rows have a role and text that the conversation had before (equal by 128 bits of hash)."""
    key = lambda r: F.struct(F.xxhash64(r["roles"], r["texts"]).alias("k1"), F.xxhash64(F.lit(7), r["roles"], r["texts"]).alias("k2"))
    keyed = materialize(runs.withColumn("keys", F.transform(F.arrays_zip("roles", "texts"), key)))
    at = F.struct("part", "no")
    each = keyed.select(F.col("conv_id").alias("c_"), at.alias("at"), F.explode(F.array_distinct("keys")).alias("key"))
    # a text that is everywhere comes once from each run, and is added up before it is shuffled
    several = each.groupBy("c_", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("c_").alias("d_"), F.col("key").alias("k_"), "first")
    later = each.join(several, F.col("c_").eqNullSafe(F.col("d_")) & (F.col("key") == F.col("k_")) & (F.col("at") > F.col("first")))
    seen = later.groupBy("c_", "at").agg(F.collect_list("key").alias("seen"))
    out = keyed.join(seen, F.col("conv_id").eqNullSafe(F.col("c_")) & (at == F.col("at")), "left").drop("c_", "at")
    before = F.transform("keys", lambda k, i: (F.array_position("keys", k) <= i) | F.coalesce(F.array_contains("seen", k), F.lit(False)))
    return out.withColumn("again", before).drop("keys", "seen")


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "no")


PIECE_COLUMNS = "part int, no int, due string, audit string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long"


def _pieces(runs: DataFrame) -> DataFrame:
    """What is to be done with each run: its part of the cheapest edits. The first run of a conversation carries the whole's numbers.

    Tables of runs, without a text, pass in order; what is held is a node's
    audit so far, and the number of rows of each run.
    """
    tables = "part int, no int, n long, low long, high long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long, initials string, ways string"

    def made(batches):
        for batch in batches:
            schema, out = _arrow(tables, batch.schema.field("conv_id").type), []
            for r in batch.to_pylist():
                found = faults(r["roles"], r["texts"], r["again"])
                initials = [x[:1] for x in r["roles"]]
                ends = (initials[0], initials[-1]) if initials else (None, None)
                # what happens to roles is told by their initials alone; a role without one is `-`
                out.append((r["conv_id"], r["part"], r["no"], len(initials), r["low"], r["high"], r["turns"], *ends, *_counts(r["roles"], found), "".join(x or "-" for x in initials), table(tuple(zip(initials, found)))))
            yield _batch(out, schema)

    def joined(batches):
        held, conv, front, schema = [], None, {0: (0, "")}, None

        def close():
            cost, audit = ended(front)
            counts, low, high, turns, tail, due = [0] * 4, None, None, 0, None, "u"
            for r in held:
                counts = [a + r[c] for a, c in zip(counts, COUNTS)]
                if r["n"]:
                    counts[3] += tail is not None and tail + r["head"] not in LEGAL
                    tail = r["tail"]
                if r["turns"]:
                    turns += r["turns"] - (high == r["low"])  # in order: only the turn at a run's end may go on
                    low, high = r["low"] if low is None else low, r["high"]
            out, at = [], 0
            for i, r in enumerate(held):
                end, n = at, 0
                while end < len(audit) and (n < r["n"] or i + 1 == len(held)):
                    n += audit[end] != "I"
                    end += 1
                piece = audit[at:end]
                numbers = (low, high, turns, *counts, cost) if i == 0 else (None, None, 0, 0, 0, 0, 0, 0)
                out.append((conv, r["part"], r["no"], due, piece, *numbers))
                due, at = replay(piece, list(r["initials"]), [""] * r["n"], due)[2], end
            return _batch(out, schema)

        for batch in batches:
            schema = schema or _arrow(PIECE_COLUMNS, batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                if held and r["conv_id"] != conv:
                    yield close()
                    held, front = [], {0: (0, "")}
                conv = r["conv_id"]
                ways, behind = json.loads(r.pop("ways")), {}
                for x, (cost, audit) in front.items():
                    for y, (c, a) in ways[x].items():
                        better(behind, int(y), (cost + c, audit + a))
                front = behind
                held.append(r)
        if held:
            yield close()

    kind = runs.schema["conv_id"].dataType.simpleString()
    t = runs.select("conv_id", "part", "no", "low", "high", "turns", "roles", "texts", "again").mapInArrow(made, f"conv_id {kind}, {tables}")
    return _in_order(t).mapInArrow(joined, f"conv_id {kind}, {PIECE_COLUMNS}")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired runs of conversations (conv_id, turn, role, text, and live: false for a row that only names its conversation).

    A row for each run, in order of (part, no): the edits' initials (audit), the
    rows they leave (roles, texts), and, where a conversation begins, its least
    and greatest turn and number of distinct turns (low, high, turns), faults
    and cost; the other runs have zeros there. whole: the conversation has but
    this run. Rows go by turn (nulls first), then role and text; repeated rows
    count each. Roles and texts must not be null. A null conv_id is one
    conversation. A role without an initial can't be kept. Other columns are
    ignored; an empty table gives no run.
    """
    runs = materialize(_runs(rows))
    split = materialize(_again(runs.where("not whole")))
    pieces = materialize(_pieces(split))
    p = pieces.select(*[F.col(c).alias(f"p_{c}") for c in pieces.columns])
    both = split.select("conv_id", "part", "no", "roles", "texts").join(p, F.col("conv_id").eqNullSafe(F.col("p_conv_id")) & (F.col("part") == F.col("p_part")) & (F.col("no") == F.col("p_no")))
    names = [x.split()[0] for x in RUN_COLUMNS.split(", ")]

    def run(batches):
        for batch in batches:
            schema, out = _arrow(RUN_COLUMNS, batch.schema.field("conv_id").type), []
            for r in batch.to_pylist():
                done = replay(r["audit"], r["roles"], r["texts"], r["due"])[:2]
                out.append((r["conv_id"], *(done[0] if n == "roles" else done[1] if n == "texts" else False if n == "whole" else r[n] for n in names)))
            yield _batch(out, schema)

    kind = rows.schema["conv_id"].dataType.simpleString()
    mended = both.select("conv_id", "part", "no", "roles", "texts", *[F.col(f"p_{x.split()[0]}").alias(x.split()[0]) for x in PIECE_COLUMNS.split(", ")[2:]])
    return runs.where("whole").unionByName(mended.mapInArrow(run, f"conv_id {kind}, {RUN_COLUMNS}"))


def turns_of(runs: DataFrame) -> DataFrame:
    """conv_id, part, no, at, role, text: repaired runs as rows, in order of (part, no, at)."""
    return runs.select("conv_id", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r")).select("conv_id", "part", "no", "at", F.col("r.roles").alias("role"), F.col("r.texts").alias("text"))


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(low: Column, high: Column, turns: Column) -> Column:
    return F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")


def digests(runs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of repaired runs.

    A digest is read from first to last: the runs of one conversation pass
    through one task in order, but a batch of them at a time.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat(r["roles"], F.lit(":"), r["texts"])), "\n")
    cols = ["conv_id", _gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), *COUNTS, "cost", "audit"]
    one = runs.where("whole").select(*cols, F.sha2(lines, 256).alias("repaired_sha256"))

    def run(batches):
        conv, numbers, audit, sha, some, schema = None, None, [], None, False, None

        def close():
            return _batch([(conv, *numbers, "".join(audit), sha.hexdigest())], schema)

        for batch in batches:
            schema = schema or _arrow(DIGEST, batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                if numbers is not None and r["conv_id"] != conv:
                    yield close()
                    numbers = None
                if numbers is None:
                    conv, numbers, audit, sha, some = r["conv_id"], [0] * 6, [], hashlib.sha256(), False
                numbers = [a + r[c] for a, c in zip(numbers, ["gaps", *COUNTS, "cost"])]
                audit.append(r["audit"])
                if r["some"]:
                    sha.update((("\n" if some else "") + r["lines"]).encode())
                    some = True
        if numbers is not None:
            yield close()

    kind = runs.schema["conv_id"].dataType.simpleString()
    several = _in_order(runs.where("not whole").select("part", "no", *cols, (F.size("roles") > 0).alias("some"), lines.alias("lines")))
    return one.unionByName(several.mapInArrow(run, f"conv_id {kind}, {DIGEST}"))


def op12(spark, sf_dir):
    """One row for each conversation of `conversations`, damaged and repaired."""
    return digests(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


# The grammar's automaton in SQL: 0 nothing yet, 1 behind s, 2 behind u, 3 a sentence. A gap takes up to two insertions.
OP12_SQL = r"""
with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
h as (select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: cast(ascii(k[i]) as bigint)),
    lambda c, b: list_reduce(range(0, 8), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(c, b)), 4294967295), 4294967295) % 20 as h from d),
r as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when h = 3 then 2 else 1 end)) as copy from h where h <> 0),
o as (select *, left(role, 1) as ini, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from r),
f as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
    when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(ini) over (partition by conv_id order by i) || ini as pair from o),
tr as (select * from (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(s, c, t)),
ins as (select * from (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)) v(s, m, n)),
step as (select ins.s, 'D' as op, cast(null as varchar) as c, ins.m as t, n, 4 as cost from ins
    union all select ins.s, 'K', tr.c, tr.t, n, 0 from ins join tr on tr.s = ins.m
    union all select ins.s, 'R', cast(null as varchar), tr.t, n, 3 from ins join tr on tr.s = ins.m where tr.c in ('u', 'a')),
w(conv_id, i, s, cost, audit) as (
    select conv_id, cast(0 as bigint), 0, cast(0 as bigint), '' from (select distinct conv_id from conversations)
    union all
    select conv_id, i, t, cost, audit from (
        select w.conv_id, f.i, step.t, cast(w.cost + 3 * n + step.cost + case when op <> 'D' and fault = 't' then 3 else 0 end as bigint) as cost, w.audit || repeat('I', n) || op as audit
        from w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join step on step.s = w.s and (op = 'D' or fault in ('', 't')) and (op <> 'K' or step.c = f.ini))
    qualify row_number() over (partition by conv_id, t order by cost, audit) = 1),
done as (select w.conv_id, w.cost + 3 * n as cost, audit || repeat('I', n) as audit from w join (select x.c as conv_id, count(f.i) as rows_ from (select distinct conv_id as c from conversations) x left join f on f.conv_id is not distinct from x.c group by 1) z
    on z.conv_id is not distinct from w.conv_id and z.rows_ = w.i join ins on ins.s = w.s and ins.m in (0, 3)
    qualify row_number() over (partition by w.conv_id order by w.cost + 3 * n, audit || repeat('I', n)) = 1),
ops as (select conv_id, unnest(range(1, length(audit) + 1)) as p, audit from done),
placed as (select conv_id, p, audit[p] as op, length(replace(audit[1:p], 'I', '')) as ri, length(replace(audit[1:p], 'D', '')) as oi, audit from ops),
said as (select e.conv_id, p, oi, op, f.role, f.text, max(case when oi = 1 and op = 'K' and f.ini = 's' then 1 else 0 end) over (partition by e.conv_id) as system from placed e left join f on f.conv_id is not distinct from e.conv_id and f.i = e.ri and op <> 'I' where op <> 'D'),
lines as (select conv_id, string_agg(case when op = 'K' then role when (oi - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end, chr(10) order by p) as body from said group by 1),
facts as (select x.c as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from (select distinct conv_id as c from conversations) x left join f on f.conv_id is not distinct from x.c group by 1)
select facts.conv_id, cast(gaps as bigint) as gaps, blank, duplicate, truncated, illegal, done.cost, done.audit, sha256(coalesce(body, '')) as repaired_sha256
from facts join done on done.conv_id is not distinct from facts.conv_id left join lines on lines.conv_id is not distinct from facts.conv_id"""
