"""Chat formatting: tool calls linked to results, ordered, validated and serialised (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Schemas: tool -> argument -> (type of a JSON value, required) or (type, required, rules). Rules: "enum" (allowed
# values), "least" and "most" (bounds of a number), "fields" (a nested schema). "*": False among the arguments
# forbids those that the schema doesn't name.
SCHEMAS = {"reply": {"text": ("STRING", True), "turn": ("BIGINT", True)}}


def canonical(json: Column) -> Column:
    """Keys sorted, no white space; null where the text isn't JSON (or repeats a key)."""
    return F.to_json(F.try_parse_json(json))


def problem(name: Column, arguments: Column, schemas: dict) -> Column:
    """Null if the arguments keep to the tool's schema, else what is wrong first."""
    v = F.try_parse_json(arguments)
    out = F.when(v.isNull(), F.lit("not json")).when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object"))
    out = out.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        for wrong, what in _violations(v, fields, "$", ""):
            out = out.when((name == tool) & wrong, F.lit(what))
    return out


def _violations(v: Column, fields: dict, path: str, label: str) -> list[tuple[Column, str]]:
    """(condition, message) for each rule of a schema at a path of the arguments."""
    out = []
    for field, spec in sorted(fields.items()):
        if field == "*":
            continue
        kind, required, rules = (*spec, {})[:3]
        at, shown = f"{path}['{field}']", f"{label}{field}"
        got = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
        there = got.isNotNull() & (got != "VOID")
        if required:
            out.append((~F.coalesce(there, F.lit(False)), f"missing {shown}"))
        # whole numbers are numbers too, and objects are told by their beginning
        right = got.startswith(kind) if kind in ("OBJECT", "ARRAY") else got.rlike("^(?:BIGINT|DECIMAL|DOUBLE)") if kind == "DOUBLE" else got == kind
        out.append((there & ~right, f"wrong type of {shown}"))
        if "enum" in rules:
            out.append((there & ~F.try_variant_get(v, at, "string").isin(*map(str, rules["enum"])), f"value of {shown} not allowed"))
        number = F.try_variant_get(v, at, "double")
        for rule, beyond in (("least", lambda bound, number=number: number < bound), ("most", lambda bound, number=number: number > bound)):
            if rule in rules:
                out.append((there & beyond(rules[rule]), f"{shown} out of bounds"))
        if "fields" in rules:
            out += [(there & wrong, what) for wrong, what in _violations(v, rules["fields"], at, f"{shown}.")]
    if fields.get("*") is False:
        names = F.map_keys(F.try_variant_get(v, path, "map<string,variant>"))
        known = [f for f in fields if f != "*"]
        out.append((F.exists(names, lambda n: ~n.isin(*known) if known else F.lit(True)), f"unknown argument in {label.rstrip('.') or 'arguments'}"))
    return out


def ranks(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, rank: 0 without (known) dependencies, else one more than the highest of them; null on or behind a cycle.

    calls: conv_id, call_id, after (array of call_ids of the same conversation).
    Runs of calls with one dependency each are shortened by pointer jumping, so
    a chain of n takes log2(n) joins; calls with several dependencies then get
    their ranks round by round, as many as such calls follow one another.
    """
    nodes = materialize(calls.groupBy("conv_id", "call_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("after", F.expr("cast(array() as array<string>)"))))).alias("after")))
    known = nodes.select(F.col("conv_id").alias("kc"), F.col("call_id").alias("kd"))
    edges = nodes.select("conv_id", "call_id", F.explode("after").alias("dep")).where("dep is not null")
    edges = materialize(edges.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("dep") == F.col("kd")), "left_semi"))
    per = edges.groupBy(F.col("conv_id").alias("pc"), F.col("call_id").alias("pd")).agg(F.count(F.lit(1)).alias("deps"), F.min("dep").alias("dep"))
    p = nodes.select("conv_id", "call_id").join(per, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("call_id") == F.col("pd")), "left")
    one = F.coalesce("deps", F.lit(0)) == 1
    # root: the nearest call up the run that has no dependency or several; dist: steps to it
    p = materialize(p.select("conv_id", "call_id", F.coalesce("deps", F.lit(0)).alias("deps"), F.when(one, F.col("dep")).otherwise(F.col("call_id")).alias("root"), F.when(one, 1).otherwise(0).alias("dist"), (~one).alias("done")))
    for _ in range(p.count().bit_length() + 1):
        if p.where("not done").isEmpty():
            break
        up = p.select(F.col("conv_id").alias("uc"), F.col("call_id").alias("ud"), F.col("root").alias("ur"), F.col("dist").alias("us"), F.col("done").alias("uo"))
        moved = p.where("not done").join(up, F.col("conv_id").eqNullSafe(F.col("uc")) & (F.col("root") == F.col("ud"))).select("conv_id", "call_id", "deps", F.col("ur").alias("root"), (F.col("dist") + F.col("us")).alias("dist"), F.col("uo").alias("done"))
        p = materialize(p.where("done").union(moved))
    ranked = p.where("deps = 0").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rd"), F.lit(0).alias("base"))
    many = p.where("deps > 1")
    if not many.isEmpty():
        at = p.select(F.col("conv_id").alias("ac"), F.col("call_id").alias("ad"), F.when(F.col("done"), F.col("root")).alias("root"), "dist")
        m = edges.join(many.select(F.col("conv_id").alias("mc"), F.col("call_id").alias("md")), F.col("conv_id").eqNullSafe(F.col("mc")) & (F.col("call_id") == F.col("md")), "left_semi")
        m = materialize(m.join(at, F.col("conv_id").eqNullSafe(F.col("ac")) & (F.col("dep") == F.col("ad"))).select("conv_id", "call_id", "root", "dist"))
        ranked = materialize(ranked)
        while True:
            got = m.join(ranked, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("root") == F.col("rd")), "left")
            ready = got.groupBy("conv_id", "call_id").agg(F.max(F.col("base").isNull()).alias("waits"), F.max(F.col("base") + F.col("dist") + 1).alias("base")).where("not waits")
            ready = materialize(ready.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rd"), "base"))
            if ready.isEmpty():
                break
            ranked = materialize(ranked.union(ready))
            m = materialize(m.join(ready, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rd")), "left_anti"))
    out = p.join(ranked, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("root") == F.col("rd")), "left")
    return out.select("conv_id", "call_id", F.when(F.col("done"), F.col("base") + F.col("dist")).alias("rank"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_id, rank, status, json: a row for each call, and one for each result without a call.

    calls: conv_id, call_id, name, arguments (JSON text), after; results:
    conv_id, call_id, position, content. A call takes its first result (smallest
    position, then content). status: ok, no result, orphan result, cycle, or
    what is wrong with the arguments. Nulls: a null call_id links to nothing.
    Repeated calls (same identifier) all take the result. One row a call, so a
    conversation of any length is never gathered in one task. Other columns are
    ignored.
    """
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", "content")).alias("r")).select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rd"), F.col("r.position").alias("position"), F.col("r.content").alias("content"), F.lit(True).alias("found"))
    c = calls.select("conv_id", "call_id", "name", "arguments", "after", F.lit(True).alias("called"))
    both = c.join(first, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rd")), "left")
    known = calls.where("call_id is not null").select(F.col("conv_id").alias("kc"), F.col("call_id").alias("kd")).distinct()
    orphans = results.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("call_id") == F.col("kd")), "left_anti")
    both = both.unionByName(orphans.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rd"), "position", "content", F.lit(True).alias("found")), allowMissingColumns=True)
    order = ranks(c.where("call_id is not null")).select(F.col("conv_id").alias("oc"), F.col("call_id").alias("od"), "rank")
    both = both.join(order, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("od")), "left")
    bad = problem(F.col("name"), F.col("arguments"), schemas)
    status = F.when(F.col("called").isNull(), "orphan result").when(bad.isNotNull(), bad).when(F.col("rank").isNull(), "cycle").when(F.col("found").isNull(), "no result").otherwise("ok")
    cid, vid = F.coalesce("conv_id", "rc"), F.coalesce("call_id", "rd")
    json = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), _text(vid), F.lit(',"name":'), _text(F.col("name")), F.lit(',"result":'), _text(F.col("content")), F.lit("}"))
    return both.select(cid.alias("conv_id"), vid.alias("call_id"), "rank", status.alias("status"), json.alias("json"))


def _text(c: Column) -> Column:
    """A text as a JSON value."""
    boxed = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(boxed, F.lit(6), F.length(boxed) - 6))


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn t calls `reply`, the assistant's turn t + 1 is its result, and a call follows that of turn t - 2.

    A null conversation or turn is left out of the identifier; null texts stay
    null in the JSON; rows of other roles are left to messages().
    """
    ident = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    calls = turns.where("role = 'user'").select(
        "conv_id", ident.alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.array(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def messages(turns: DataFrame) -> DataFrame:
    """Rows as link() makes them for the turns that are neither call nor result: status `message`, the turn as JSON."""
    json = F.concat(F.lit('{"role":'), _text(F.col("role")), F.lit(',"text":'), _text(F.col("text")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    ident = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    other = turns.where(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"))
    return other.select("conv_id", ident.alias("call_id"), F.lit(None).cast("int").alias("rank"), F.lit("message").alias("status"), json.alias("json"))


def op5(spark, sf_dir):
    """conv_id, call_id, rank, status, json for every turn of `conversations`: exchanges() linked, and messages()."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link(*exchanges(turns)).union(messages(turns))


LINKED_SQL = """
with recursive c as (select conv_id, turn, text, conv_id || ':' || turn as call_id from conversations where role = 'user'),
r as (select conv_id, conv_id || ':' || (turn - 1) as call_id, min(text) as content from conversations where role = 'assistant' group by all),
o(conv_id, turn, call_id, rank) as (
  select conv_id, turn, call_id, 0 from (select distinct conv_id, turn, call_id from c) x where not exists (select 1 from c y where y.conv_id = x.conv_id and y.turn = x.turn - 2)
  union all
  select x.conv_id, x.turn, x.call_id, o.rank + 1 from (select distinct conv_id, turn, call_id from c) x join o on o.conv_id = x.conv_id and o.turn = x.turn - 2)
select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, cast(o.rank as integer) as rank,
  case when c.call_id is null then 'orphan result' when c.text is null then 'missing text' when r.call_id is null then 'no result' else 'ok' end as status,
  '{"arguments":' || case when c.call_id is null then 'null' else '{' || case when c.text is null then '' else '"text":' || cast(to_json(c.text) as varchar) || ',' end || '"turn":' || c.turn || '}' end
  || ',"id":' || cast(to_json(coalesce(c.call_id, r.call_id)) as varchar) || ',"name":' || case when c.call_id is null then 'null' else '"reply"' end
  || ',"result":' || case when r.content is null then 'null' else cast(to_json(r.content) as varchar) end || '}' as json
from c full outer join r on c.conv_id = r.conv_id and c.call_id = r.call_id
left join o on o.conv_id = c.conv_id and o.call_id = c.call_id
"""

OP5_SQL = f"""select * from ({LINKED_SQL}) union all
select conv_id, conv_id || ':' || turn as call_id, cast(null as integer) as rank, 'message' as status,
  '{{"role":' || case when role is null then 'null' else cast(to_json(role) as varchar) end || ',"text":' || case when text is null then 'null' else cast(to_json(text) as varchar) end || ',"turn":' || coalesce(cast(turn as varchar), 'null') || '}}' as json
from conversations where role is null or role not in ('user', 'assistant')"""
