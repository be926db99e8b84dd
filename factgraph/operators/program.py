"""Pointer facts as instructions: expression trees (JSON) become flat rows that points_to.solve reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.graph import checkpointed, watched

#: Deeper trees than this are refused.
DEPTH = 64


def expressions(roots: DataFrame) -> DataFrame:
    """op, r, x, name: instructions of expression trees (r, e), level by level; a node's r is its parent's and its place there.

    Trees: loc {id}, deref {value}, field {base, field}, union {items}, addr
    {value}, function {id}; others have neither locations nor values. A node
    has its locations and its values under the same r.
    """
    none = F.lit(None).cast("string")
    row = lambda op, x, name: F.struct(F.lit(op).alias("op"), F.col("r"), x.alias("x"), name.alias("name"))
    get = lambda key: F.get_json_object("e", f"$.{key}")
    child = lambda key: F.concat("r", F.lit(f".{key}"))
    front, found = roots.select("r", "e").where("e is not null"), []
    for _ in range(DEPTH):
        front, n = watched(front, n=F.count("*"))
        if not n["n"]:
            break
        op = get("op")
        items = F.from_json(get("items"), "array<string>")
        kids = F.when(op.isin("deref", "addr"), F.array(F.struct(child("value").alias("r"), get("value").alias("e")))).when(op == "field", F.array(F.struct(child("base").alias("r"), get("base").alias("e")))).when(
            op == "union", F.transform(items, lambda e, i: F.struct(F.concat("r", F.lit(".i"), i).alias("r"), e.alias("e"))))
        read = row("READ", F.col("r"), none)
        made = F.when(op == "loc", F.array(row("LOC", none, get("id")), read)).when(op == "deref", F.array(row("DEREF", child("value"), none), read)).when(op == "field", F.array(row("FIELD", child("base"), get("field")), read)).when(
            op == "addr", F.array(row("ADDR", child("value"), none))).when(op == "function", F.array(row("FUN", none, get("id")))).when(
            op == "union", F.flatten(F.transform(items, lambda e, i: F.array(row("UNION_L", F.concat("r", F.lit(".i"), i), none), row("UNION_V", F.concat("r", F.lit(".i"), i), none)))))
        found.append(front.select(F.inline(made)))
        front = front.select(F.inline(kids)).where("e is not null")
    else:
        raise ValueError(f"an expression is deeper than {DEPTH}")
    return reduce(DataFrame.unionByName, found) if found else roots.select(none.alias("op"), "r", none.alias("x"), none.alias("name")).limit(0)


def tree_key(e: Column) -> Column:
    """r of an expression tree by its text: trees of one text are one expression, however many places have it."""
    return F.concat(F.lit("e:"), F.md5(e))


def instructions(constraints: DataFrame, calls: DataFrame, items: DataFrame) -> DataFrame:
    """The program of constraints (id, lhs, rhs), calls (site, target, expression, arguments, result) and indirect accesses (item, location). Trees stand under tree_key, calls under s:site."""
    s, none = F.concat(F.lit("s:"), F.col("site").cast("string")), F.lit(None).cast("string")
    key = lambda name: tree_key(F.col(name))
    args = calls.select("site", F.posexplode("arguments").alias("arg", "e"))
    trees = [constraints.select(F.explode(F.array("lhs", "rhs")).alias("e")), calls.select(F.explode(F.concat(F.array(F.when(F.col("target").isNull(), F.col("expression")), F.col("result")), F.coalesce("arguments", F.array().cast("array<string>")))).alias("e")), items.select(F.col("location").alias("e"))]
    rows = [constraints.select(F.lit("ASSIGN").alias("op"), key("lhs").alias("r"), key("rhs").alias("x"), none.alias("name")).distinct(),
            calls.where("target is not null").select(F.lit("TARGET").alias("op"), s.alias("r"), none.alias("x"), F.col("target").alias("name")),
            calls.where("target is null").select(F.lit("CALLEE").alias("op"), s.alias("r"), key("expression").alias("x"), none.alias("name")),
            args.select(F.lit("ARG").alias("op"), s.alias("r"), key("e").alias("x"), F.col("arg").cast("string").alias("name")),
            calls.where("result is not null").select(F.lit("RESULT").alias("op"), s.alias("r"), key("result").alias("x"), none.alias("name"))]
    roots = reduce(DataFrame.unionByName, trees).where("e is not null").distinct().select(key("e").alias("r"), "e")
    return expressions(roots).unionByName(reduce(DataFrame.unionByName, rows))


def call_key(expression: Column) -> Column:
    """Where the targets of the calls through a pointer stand: calls through one expression have the same ones."""
    return F.concat(F.lit("c:"), F.md5(expression))


#: What of a tree says whether it is plain: a place, a function or the address of a place.
PLAIN = "op string, id string, value struct<op: string, id: string>"


def _parsed(tree: str, made) -> Column:
    """The rows of one struct, made(tree) of a tree that is parsed once."""
    return F.inline(F.transform(F.array(F.from_json(tree, PLAIN)), made))


def _place(p: Column) -> Column:
    return F.when(p["op"] == "loc", p["id"])


def pointer(location: Column) -> Column:
    """The tree whose values are the places of a location, null where they are not values of a tree."""
    return F.when(F.get_json_object(location, "$.op") == "deref", F.get_json_object(location, "$.value"))


def _stores(rows: DataFrame) -> DataFrame:
    """op, r, x, name of values that go to known places (place, e): what a plain tree says is a fact or a flow at once, other trees are given by their key."""
    none, place = F.lit(None).cast("string"), F.col("place")
    row = lambda op, x, name: F.struct(F.lit(op).alias("op"), place.alias("r"), x.alias("x"), name.alias("name"))

    def made(p):
        return F.when(p["op"] == "loc", row("FLOW", p["id"], none)).when(p["op"] == "function", row("HOLDS", none, F.concat(F.lit("fn:"), p["id"]))).when(
            (p["op"] == "addr") & (p["value"]["op"] == "loc"), row("HOLDS", none, p["value"]["id"])).otherwise(row("GIVE", tree_key(F.col("e")), none))

    return rows.where("place is not null and e is not null").select(_parsed("e", made)).where("x is not null or name is not null")


def _unread(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """r of plain trees (r, id, read) of places that are only stored to: no other tree names them, no pointer to them can be made, no call reads them as what it returns."""
    named = trees.where("read").select("id").union(nodes.where("op = 'LOC'").select("name")).distinct()
    return trees.where("not read and not endswith(id, ':return') and not contains(id, '/')").join(named, "id", "left_anti").select("r")


def run_instructions(constraints: DataFrame, calls: DataFrame, items: DataFrame) -> DataFrame:
    """instructions() in the form that a run needs, which asks for the values of arguments, the targets of calls through pointers (under call_key), and of items for the values of pointer(location), else for the locations.

    A direct call is no instruction: its arguments go to known places, and so do
    constraints on a named place. Stores to places that nothing can read, and
    values of trees that only stand for a location, are left out: no answer
    depends on them.
    """
    none = F.lit(None).cast("string")
    key = lambda name: tree_key(F.col(name))
    # Whether something reads a tree's places, and whether something reads its values.
    used = [(constraints.select("lhs"), False, False), (calls.select("result"), False, False), (items.where(pointer(F.col("location")).isNull()).select("location"), True, False), (items.select(pointer(F.col("location"))), True, True),
            (constraints.select("rhs"), True, True), (calls.where("target is null").select("expression"), True, True), (calls.select(F.explode("arguments")), True, True)]
    roots = reduce(DataFrame.union, [t.toDF("e").select("e", F.lit(read).alias("read"), F.lit(value).alias("value")) for t, read, value in used]).where("e is not null")
    roots = roots.groupBy("e").agg(F.bool_or("read").alias("read"), F.bool_or("value").alias("value"))
    roots = checkpointed(roots.select(key("e").alias("r"), "e", "read", "value", _parsed("e", lambda p: F.struct(_place(p).alias("id")))))
    # A root's own key has no point; below it every tree may be read.
    places = expressions(roots.where("not value and (read or id is null)").select("r", "e")).where("op <> 'READ' or contains(r, '.')")
    nodes = checkpointed(expressions(roots.where("value").select("r", "e")).unionByName(places))
    unread = checkpointed(_unread(roots.where("id is not null").select("r", "id", "read"), nodes))
    kept = roots.where("not read and id is not null").join(unread, "r", "left_anti").select(F.lit("LOC").alias("op"), "r", none.alias("x"), F.col("id").alias("name"))

    stored = lambda df, tree, *more: df.where(F.col(tree).isNotNull()).select(key(tree).alias("r"), *more, _parsed(tree, lambda p: F.struct(_place(p).alias("place")))).join(unread, "r", "left_anti")
    assigned = stored(constraints.where("rhs is not null"), "lhs", "rhs")
    through, named = F.col("target").isNull(), F.col("place").isNotNull()
    at = call_key(F.col("expression"))
    taken = stored(calls, "result", F.when(through, at).alias("at"), F.concat(F.col("target"), F.lit(":return")).alias("returned"))
    taken = taken.select(F.when(F.col("at").isNotNull(), "RESULT").when(named, "FLOW").otherwise("TAKE").alias("op"), F.coalesce("at", "place", "r").alias("r"), F.when(F.col("at").isNotNull(), F.col("r")).otherwise(F.col("returned")).alias("x"), none.alias("name"))
    args = calls.select("target", "expression", F.posexplode("arguments").alias("arg", "e"))
    waiting = [assigned.where(~named).select(F.lit("ASSIGN").alias("op"), "r", key("rhs").alias("x"), none.alias("name")), calls.where(through).select(F.lit("CALLEE"), at, key("expression"), none), args.where(through).select(F.lit("ARG"), at, key("e"), F.col("arg").cast("string"))]
    stores = [_stores(assigned.select("place", F.col("rhs").alias("e"))), _stores(args.where(~through).select(F.concat_ws(":", "target", F.lit("param"), "arg").alias("place"), "e"))]
    return reduce(DataFrame.union, [nodes.select("op", "r", "x", "name"), kept, taken, *stores, reduce(DataFrame.union, waiting).distinct()])
