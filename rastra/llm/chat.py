"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation and call id. Dependencies between calls give each call a level,
so that sorting by level is a topological order; arguments are checked against the tools' schemas; and each
link becomes one line of canonical JSON: keys sorted, no blanks. Everything is Spark's own expressions and joins; no
conversation is ever gathered in one place, so a hot one is just more rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastra.llm.common import checkpointed, stored

#: What a schema's type accepts, as the start of the type's name in Spark.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}

#: Nodes of a graph that are folded together, as a power of two, and the unknown parents that a node has there at most.
BLOCK_BITS, WIDE = 11, 64


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """array<string> of what is wrong with a call's arguments (JSON text), in a fixed order; empty if nothing is.

    A schema has ``properties`` (field to type, a key of TYPES), ``required`` (fields) and ``additional`` (whether other
    fields may occur, by default not). Null, empty or broken JSON, anything but an object, and names without a schema are errors.
    """
    fields = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    text = lambda c: F.when(c, F.lit(None).cast("string"))
    checks: list[Column] = []
    for tool in sorted(schemas):
        schema = schemas[tool]
        properties, required = schema.get("properties", {}), set(schema.get("required", ()))
        of_tool = name == tool
        for field in sorted(set(properties) | required):
            there = F.map_contains_key(fields, field)
            if field in required:
                checks.append(F.when(of_tool & ~there, F.lit(f"{field}: missing")))
            if field in properties:
                kind = F.schema_of_variant(F.element_at(fields, F.lit(field)))
                checks.append(F.when(of_tool & there & ~kind.rlike(f"^({TYPES[properties[field]]})"), F.lit(f"{field}: not {properties[field]}")))
        if not schema.get("additional", False):
            more = F.array_except(F.map_keys(fields), F.array(*[F.lit(f) for f in properties]).cast("array<string>"))
            checks.append(F.when(of_tool & (F.size(more) > 0), F.concat(F.array_join(F.array_sort(more), ", "), F.lit(": unknown"))))
    found = F.array_compact(F.array(*checks, text(F.lit(True))))
    known = F.coalesce(name.isin(*schemas) if schemas else F.lit(False), F.lit(False))
    return F.when(~known, F.array(F.lit("no such tool"))).when(fields.isNull(), F.array(F.lit("arguments: not an object"))).otherwise(found)


def _fold(waiting: DataFrame) -> DataFrame:
    """(child, level, closed) of nodes, by block, from rows (child, base, deps, fits): deps are unknown parents with distances.

    Each block is one row: its nodes in an array, and at every step each node whose parents are known takes its level. A step that
    changes nothing ends it. ``base`` is what the known parents ask for. Nodes that wait for other blocks, and those that do not fit, stay unknown in this round;
    without any such node the block is closed: what is unknown then is on a cycle or behind one, and stays so.
    """
    here = F.shiftright("child", BLOCK_BITS)
    narrow = F.col("fits") & F.forall("deps", lambda d: F.coalesce(F.shiftright(d["parent"], BLOCK_BITS) == here, F.lit(False)))
    one = waiting.groupBy(here.alias("block")).agg(F.array_sort(F.collect_list(F.when(narrow, F.struct("child", "base", "deps")))).alias("nodes"), F.bool_and(narrow).alias("closed")).where(F.size("nodes") > 0)
    place = lambda x: x.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    spots = F.transform("nodes", lambda x: place(x["child"]))
    one = one.select("nodes", "closed", spots.alias("spots"))
    # What is not among the block's nodes has no place and stays unknown in this round.
    local = F.transform("nodes", lambda x: F.struct(x["base"].alias("base"), F.transform(x["deps"], lambda d: F.struct(F.array_position(F.col("spots"), place(d["parent"])).cast("int").alias("at"), d["d"].alias("d"))).alias("deps")))
    one = one.select("nodes", "closed", local.alias("local"))
    begin = F.struct(F.transform("local", lambda x: F.when(F.size(x["deps"]) == 0, x["base"])).alias("levels"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        of = lambda d: F.when(d["at"] > 0, F.element_at(state["levels"], F.when(d["at"] > 0, d["at"]).otherwise(1)) + d["d"])
        reached = lambda x: F.when(F.forall(x["deps"], lambda d: of(d).isNotNull()), F.greatest(x["base"], F.array_max(F.transform(x["deps"], of))))
        moved = F.transform("local", lambda x, i: F.coalesce(F.get(state["levels"], i), reached(x)))
        grown = F.transform(F.array(moved), lambda m: F.struct(m.alias("levels"), (F.size(F.array_compact(m)) == F.size(F.array_compact(state["levels"]))).alias("done")))
        return F.when(state["done"], state).otherwise(F.get(grown, F.lit(0)))

    found = F.aggregate(F.sequence(F.lit(1), F.size("local")), begin, step)["levels"]
    return one.select("closed", F.explode(F.arrays_zip(F.transform("nodes", lambda x: x["child"]).alias("child"), found.alias("level"))).alias("x")).select("x.child", "x.level", "closed")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of a directed graph: 0 without dependencies, else one more than the largest level among them; null on and behind cycles.

    ``nodes`` has distinct column node, ``edges`` has child and parent, both nodes. If nodes has a column ``place``, nodes with near places
    are expected to wait for each other (any order is right, but takes more rounds).

    The nodes that wait are numbered in order of place and name, and blocks of 2 ** BLOCK_BITS neighbours are folded in a row each, so that a graph or
    a conversation of that size takes one round, whatever its shape. What crosses blocks goes on in rounds, each over the edges that
    still wait; there, edges to an unknown parent that has a single edge itself skip over it with the summed distance, so that a chain of n blocks
    takes about log n rounds. A ladder of n blocks takes n.
    """
    by_place = ["place", "node"] if "place" in nodes.columns else ["node"]
    pairs = checkpointed(edges.select("child", "parent").distinct())
    involved = pairs.select(F.col("child").alias("node")).union(pairs.select(F.col("parent").alias("node"))).distinct()
    numbered = nodes.join(involved, "node", "left_semi").repartitionByRange(*by_place).sortWithinPartitions(*by_place)
    numbered = checkpointed(numbered.select("node", F.monotonically_increasing_id().alias("id")))
    number = lambda c: numbered.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    left = checkpointed(pairs.join(number("child"), "child").join(number("parent"), "parent").select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"), F.lit(1).cast("long").alias("d")))
    most = numbered.count()
    bases = left.select("child", F.lit(0).cast("long").alias("base")).distinct()
    new = checkpointed(numbered.select(F.col("id").alias("child")).join(left.select("child"), "child", "left_anti").select("child", F.lit(0).cast("long").alias("level")))
    parts = [new]
    while not left.isEmpty():
        # Edges to parents that are known by now become the child's base.
        seen = left.join(new.select(F.col("child").alias("parent"), "level"), "parent", "left")
        by_child = seen.groupBy("child").agg(F.max(F.col("level") + F.col("d")).alias("base"), F.count(F.when(F.col("level").isNull(), 1)).alias("unknown"), F.first(F.when(F.col("level").isNull(), F.struct("parent", "d")), ignorenulls=True).alias("only"))
        state = checkpointed(bases.join(by_child, "child").select("child", F.greatest(bases["base"], F.coalesce(by_child["base"], F.lit(0))).alias("base"), "unknown", "only"))
        rest = checkpointed(seen.where("level is null").select("child", "parent", "d"))
        waiting = rest.join(state.where(f"unknown between 1 and {WIDE}").select("child", "base"), "child").groupBy("child", "base").agg(F.collect_list(F.struct("parent", "d")).alias("deps"))
        none = F.array().cast("array<struct<parent:bigint,d:bigint>>")
        others = state.where(f"unknown = 0 or unknown > {WIDE}").select("child", "base", none.alias("deps"), (F.col("unknown") == 0).alias("fits"))
        folded = checkpointed(_fold(waiting.withColumn("fits", F.lit(True)).union(others)))
        new = folded.where("level is not null").select("child", "level")
        parts.append(new)
        # What is known needs no edges any more, nor does what never will be.
        after = rest.join(folded.where("level is not null or closed").select("child"), "child", "left_anti")
        # A node with one unknown parent and no known one is skipped: who waits for it waits for that parent, and longer.
        chain = state.where("unknown = 1 and base = 0").select(F.col("child").alias("parent"), F.col("only.parent").alias("skip"), F.col("only.d").alias("more")).join(new.select(F.col("child").alias("parent")), "parent", "left_anti")
        hop = after.join(chain, "parent", "left").select("child", F.coalesce("skip", "parent").alias("parent"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        # A path longer than the number of nodes goes round a cycle: the edge stays, without a parent that could ever be known.
        far = F.col("d") > most
        hop = hop.select("child", F.when(~far, F.col("parent")).alias("parent"), F.when(far, most + 1).otherwise(F.col("d")).alias("d"))
        after = checkpointed(hop.groupBy("child", "parent").agg(F.max("d").alias("d")))
        if new.isEmpty() and after.exceptAll(left).isEmpty():
            break  # only nodes that wait for a cycle are left
        left, bases = after, state.select("child", "base")
    return nodes.select("node").join(involved, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")).union(numbered.join(reduce(DataFrame.union, parts).withColumnRenamed("child", "id"), "id", "left").select("node", "level"))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping], after: DataFrame | None = None, repeats: bool = False) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, turn, call_id, level, status, errors, json.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text). ``results``: conv_id, turn, call_id, content. ``after``: conv_id, call_id,
    parent_id; pairs that name unknown calls are left out. Other columns are not read. status is linked, unanswered or orphan.
    Of calls or results that share an id, the first by turn (then by content) counts; with ``repeats`` the later ones stay too: the
    n-th call of an id meets its n-th result, what is left over is unanswered or an orphan, and all calls of an id wait for
    the calls that the id waits for, whose first one counts. A call without an id is
    unanswered, and a result without one is an orphan; each stays a row. Ids are compared within a conversation; a null
    conversation is one of its own. level is null for orphans, rows without an id and calls on a cycle.
    """
    key = F.to_json(F.struct(F.col("conv_id").alias("c"), F.col("call_id").alias("i")))
    same = Window.partitionBy("key")

    def numbered(df: DataFrame, *values: str) -> DataFrame:
        """The calls or results of each id by turn, numbered from 1; only the first of each without ``repeats``."""
        if repeats:
            return df.withColumn("nth", F.row_number().over(same.orderBy("turn", *values)))
        return df.groupBy("key").agg(F.min(F.struct("turn", *values)).alias("v"), F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id")).select("key", "conv_id", "call_id", "v.*", F.lit(1).alias("nth"))

    named_calls = calls.where("call_id is not null").select(key.alias("key"), "conv_id", "call_id", "turn", "name", "arguments")
    named_results = results.where("call_id is not null").select(key.alias("key"), "conv_id", "call_id", "turn", "content")
    # Each is read by several joins; files keep them from being numbered again for each.
    asked = stored(numbered(named_calls, "name", "arguments"), "calls")
    told = stored(numbered(named_results, "content"), "results")
    numbers = asked.select("key", "nth")
    if after is not None:
        parent = F.to_json(F.struct(F.col("conv_id").alias("c"), F.col("parent_id").alias("i")))
        ids = checkpointed(asked.where("nth = 1").select(F.col("key").alias("node"), F.struct("conv_id", "turn").alias("place")))
        edges = after.where("call_id is not null and parent_id is not null").select(key.alias("child"), parent.alias("parent"))
        edges = edges.join(ids.select(F.col("node").alias("child")), "child", "left_semi").join(ids.select(F.col("node").alias("parent")), "parent", "left_semi")
        asked = asked.join(checkpointed(levels(ids, edges)).withColumnRenamed("node", "key"), "key", "left")
    else:
        asked = asked.withColumn("level", F.lit(0).cast("long"))
    answer = told.select("key", "nth", F.col("content").alias("result"))
    linked = asked.join(answer.withColumn("answered", F.lit(True)).hint("shuffle_hash"), ["key", "nth"], "left").withColumn("status", F.when(F.col("answered"), "linked").otherwise("unanswered"))
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "result", "level", "status"]
    null = lambda kind: F.lit(None).cast(kind)
    nameless = calls.where("call_id is null").select("conv_id", "turn", null("string").alias("call_id"), "name", "arguments", null("string").alias("result"), null("long").alias("level"), F.lit("unanswered").alias("status"))
    orphan = told.join(numbers, ["key", "nth"], "left_anti").select("conv_id", "turn", "call_id", "content").union(results.where("call_id is null").select("conv_id", "turn", null("string"), "content"))
    orphan = orphan.select("conv_id", "turn", "call_id", null("string").alias("name"), null("string").alias("arguments"), F.col("content").alias("result"), null("long").alias("level"), F.lit("orphan").alias("status"))
    rows = linked.select(columns).union(nameless).union(orphan)
    errors = F.when(F.col("status") != "orphan", argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    line = F.to_variant_object(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "level", "name", "result", "status"))
    return rows.select("conv_id", "turn", "call_id", "level", "status", errors.alias("errors"), F.to_json(line).alias("json"))


def from_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, after) of plain conversations (conv_id, turn, role, text): a user's turn calls ``reply``, the assistant's next turn is the result.

    A call waits for the user's turn two before it, if there is one. Null turns have no id.
    """
    said = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.concat(F.lit("reply-"), t.cast("string"))
    user = said.where("role = 'user'")
    calls = user.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"))
    results = said.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    after = user.where("turn >= 2").select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"))
    return calls, results, after


#: The schema of the calls that from_turns() makes.
REPLY = {"reply": {"properties": {"prompt": "string", "turn": "integer"}, "required": ("prompt", "turn")}}
