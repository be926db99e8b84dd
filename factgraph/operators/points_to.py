"""Inclusion-based points-to over flat instructions: a least fixpoint of joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factgraph.operators.graph import checkpointed, written

#: Limits, and the number of rounds whose tables are put together in one.
ROUNDS, FIELDS, TABLES = 1000, 16, 32
FACT = "rel string, key string, value string"
FN = "fn:"
#: Places that no program has: what all functions in one place return, and what one argument of theirs is given.
SHARED = "\u0001"
#: By instruction that waits for nothing: the relation of its fact.
STARTS = {"LOC": "L", "FUN": "V", "TARGET": "T", "HOLDS": "P", "FLOW": "C", "GIVE": "S", "TAKE": "Q"}
#: By relation of a new fact: the instructions that it completes, and relations on the same key that it meets.
COMPLETES = {"V": ["DEREF", "UNION_V", "CALLEE"], "VH": ["DEREF", "UNION_V", "CALLEE"], "L": ["FIELD", "UNION_L", "ADDR", "READ", "ASSIGN"], "T": ["ARG", "RESULT"], "TH": ["ARG", "RESULT"]}
MEETS = {"S": ["V", "VH"], "Q": ["L"], "C": ["P"], "LH": ["P"], "NA": ["P"], "NR": ["P"]}
#: By relation of a new fact: the relations of what may follow.
MAKES = {"V": "L V T P", "VH": "LH VH TH C", "L": "L V VH S C", "T": "S Q", "TH": "S Q NA NR", "S": "P C", "Q": "C", "C": "P", "LH": "L", "NA": "C", "NR": "C", "P": "P L C"}


@dataclass
class Solution:
    """What solve() has found. table: rel, key, value of L, P, and V and T as sets: own members (V, T) and places all of whose members belong to it (VH, TH)."""

    table: DataFrame
    hit: bool

    def rows(self, *rels: str) -> DataFrame:
        """key, value of relations as they are kept."""
        return self.table.where(F.col("rel").isin(*rels)).select("key", "value")

    def sets(self, rel: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """V or T of keys (key, ...): keys with the sources of their set, and source lists with each value once.

        Keys of the same sources share a set, so that what a place holds is
        written down once and not for everyone who reads it.
        """
        mark = lambda r, sign: self.rows(r).select("key", F.concat(F.lit(sign), "value").alias("source"))
        sources = mark(rel, "=").union(mark(f"{rel}H", "*")).groupBy("key").agg(F.array_sort(F.collect_set("source")).alias("sources"))
        of = keys.join(sources, "key")
        each = of.select("sources").distinct().select("sources", F.explode("sources").alias("source")).select("sources", F.substring("source", 1, 1).alias("sign"), F.expr("substring(source, 2)").alias("value"))
        held = self.rows("P").withColumnRenamed("key", "place").withColumnRenamed("value", "member")
        if rel == "T":
            held = held.where(F.startswith("member", F.lit(FN))).select("place", F.expr(f"substring(member, {len(FN) + 1})").alias("member"))
        through = each.where("sign = '*'").join(held, F.col("value") == F.col("place")).select("sources", F.col("member").alias("value"))
        return of, each.where("sign = '='").select("sources", "value").union(through).distinct()

    def members(self, rel: str, keys: DataFrame | None = None) -> DataFrame:
        """keys (key, ...; all if none) with each value of theirs in V or T."""
        of, values = self.sets(rel, self.rows(rel, f"{rel}H").select("key").distinct() if keys is None else keys)
        return of.join(values, "sources").drop("sources")

    @cached_property
    def known(self) -> DataFrame:
        """rel, key, value of all that holds in L, V, P and T."""
        named = lambda rel, df: df.select(F.lit(rel).alias("rel"), "key", "value")
        parts = [named("L", self.rows("L")), named("P", self.rows("P").where(~F.startswith("key", F.lit(SHARED)))), named("V", self.members("V")), named("T", self.members("T"))]
        return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _shared(name: Column, place: Column) -> Column:
    return F.concat(F.lit(SHARED), name, F.lit(SHARED), place)


def _fact(rel: str, key: Column, value: Column) -> Column:
    return F.struct(F.lit(rel).alias("rel"), key.alias("key"), value.alias("value"))


def _completed(program: DataFrame, new: DataFrame) -> DataFrame:
    """What new facts make of the instructions that wait for their key (at)."""
    j = new.join(program, F.col("key") == F.col("at"))
    op, rel, r, x, name, value = (F.col(c) for c in ("op", "rel", "r", "x", "name", "value"))
    is_fn, target = F.startswith(value, F.lit(FN)), F.expr(f"substring(value, {len(FN) + 1})")
    param, back = F.concat_ws(":", F.lit("param"), name), F.lit("return")
    cases = [
        ("DEREF", "V", ~is_fn, [_fact("L", r, value)]), ("DEREF", "VH", None, [_fact("LH", value, r)]), ("FIELD", "L", None, [_fact("L", r, F.concat(value, F.lit("/"), name))]), ("UNION_L", "L", None, [_fact("L", r, value)]),
        ("UNION_V", "V", None, [_fact("V", r, value)]), ("UNION_V", "VH", None, [_fact("VH", r, value)]), ("ADDR", "L", None, [_fact("V", r, value)]), ("READ", "L", None, [_fact("VH", r, value)]),
        ("CALLEE", "V", is_fn, [_fact("T", r, target)]), ("CALLEE", "VH", None, [_fact("TH", r, value)]), ("ASSIGN", "L", None, [_fact("S", x, value)]),
        ("ARG", "T", None, [_fact("S", x, F.concat_ws(":", value, param))]), ("ARG", "TH", None, [_fact("S", x, _shared(param, value)), _fact("NA", value, param)]),
        ("RESULT", "T", None, [_fact("Q", x, F.concat_ws(":", value, back))]), ("RESULT", "TH", None, [_fact("Q", x, _shared(back, value)), _fact("NR", value, back)])]
    made = F
    for op_is, rel_is, more, facts in cases:
        holds = (op == op_is) & (rel == rel_is)
        made = made.when(holds if more is None else holds & more, F.array(*facts))
    return j.select(F.inline(made))


def _met(movers: DataFrame, held: DataFrame) -> DataFrame:
    """What flows where: movers S, Q, C, LH, NA, NR with the facts on their key."""
    m = movers.select(F.col("rel").alias("move"), "key", F.col("value").alias("to"))
    j = m.join(held, "key")
    move, rel, key, to, value = (F.col(c) for c in ("move", "rel", "key", "to", "value"))
    fits = F.lit(False)
    for name, rels in MEETS.items():
        fits = fits | (move == name) & rel.isin(*rels)
    is_fn, target = F.startswith(value, F.lit(FN)), F.expr(f"substring(value, {len(FN) + 1})")
    fits = fits & ((move != "LH") | ~is_fn) & (~move.isin("NA", "NR") | is_fn)
    own, shared = F.concat_ws(":", target, to), _shared(to, key)
    made = F.when((move == "S") & (rel == "VH"), _fact("C", value, to)).when(move == "Q", _fact("C", to, value)).when(move == "LH", _fact("L", to, value)).when(
        move == "NA", _fact("C", shared, own)).when(move == "NR", _fact("C", own, shared)).otherwise(_fact("P", to, value))
    return j.where(fits).select(made.alias("fact")).select("fact.*")


def solve(program: DataFrame, rounds: int = ROUNDS, fields: int = FIELDS) -> tuple[DataFrame, bool]:
    """rel, key, value of all that holds, and whether a limit was hit (POINTS_TO_LIMIT).

    program: op, r, x, name. Relations: L (locations of an expression), V (its
    values), P (what a location may hold), T (targets of a call).
      LOC r, name: L(r, name)             FUN r, name: V(r, fn:name)       TARGET r, name: T(r, name)
      DEREF r, x: L(r, p) if V(x, p), p no function                        FIELD r, x, name: L(r, p/name) if L(x, p)
      UNION_L r, x: L(r, p) if L(x, p)    UNION_V r, x: V(r, q) if V(x, q) ADDR r, x: V(r, p) if L(x, p)
      READ r, x: V(r, q) if L(x, p), P(p, q)                               ASSIGN r, x: P(p, q) if L(r, p), V(x, q)
      CALLEE r, x: T(r, t) if V(x, fn:t)
      ARG r, x, name: P(t:param:name, q) if T(r, t), V(x, q)               RESULT r, x: P(p, q) if T(r, t), L(x, p), P(t:return, q)
      HOLDS r, name: P(r, name)           FLOW r, x: P(r, q) if P(x, q)    GIVE r, x: P(r, q) if V(x, q)
      TAKE r, x: P(p, q) if L(r, p), P(x, q)
    Paths of more than `fields` fields are not followed and count as
    the limit, as do more rounds than `rounds`.
    """
    found = solution(program, rounds, fields)
    return found.known, found.hit


def solution(program: DataFrame, rounds: int = ROUNDS, fields: int = FIELDS) -> Solution:
    """The rules of solve() with V and T kept as sets: many expressions read one place, and many calls go to all that it holds.

    VH(r, p), TH(r, p): all that p holds, or its functions, belong to r. These
    move what is found on their key: S(x, p): values of x go to p. Q(x, s): what
    s holds goes to the locations of x. C(s, p): what s holds goes to p. LH(p, r):
    what p holds are locations of r. NA(p, n), NR(p, n): the functions that p holds
    are given argument n, or their results are taken, by way of one shared place.
    A round takes the new facts to the instructions and movers of their key,
    reads only the relations that they meet or make, and writes what is new.
    """
    spark = program.sparkSession
    program = checkpointed(program.select("op", "r", "x", "name"))
    op, first = F.col("op"), F.col("op").isin(*STARTS)
    rel = F.create_map(*(F.lit(t) for pair in STARTS.items() for t in pair))[op]
    start = program.where(first).select(rel.alias("rel"), F.when(op.isin("FLOW", "GIVE"), F.col("x")).otherwise(F.col("r")).alias("key"), F.when(op == "FUN", F.concat(F.lit(FN), "name")).when(op.isin("FLOW", "GIVE"), F.col("r")).when(op == "TAKE", F.col("x")).otherwise(F.col("name")).alias("value")).distinct()
    waiting = program.where(~first).withColumn("at", F.when(op.isin("ASSIGN", "ARG", "RESULT"), F.col("r")).otherwise(F.col("x")))
    read = lambda *at: spark.read.schema(FACT).parquet(*at)
    real = F.col("rel").isin("L", "P", "V", "T") & ~F.startswith("key", F.lit(SHARED))
    deep = F.length("value") - F.length(F.replace("value", F.lit("/"))) >= fields
    # What a program names itself is deep only where it is stored.
    paths, hit, new = [], False, start.withColumn("deep", (F.col("rel") == "P") & F.coalesce(deep, F.lit(False)))
    for round_no in range(rounds + 2):
        seen = Observation()
        new = new.observe(seen, F.count_if("deep").alias("deep"), *(F.count_if((F.col("rel") == rel) & ~F.col("deep")).alias(rel) for rel in MAKES))
        paths.append(written(new.where("not deep").select("rel", "key", "value")))
        n = seen.get
        hit = hit or n["deep"] > 0
        rels = [rel for rel in MAKES if n[rel]]
        if not rels:
            break
        if round_no > rounds:
            hit = True
            break
        delta, before = read(paths[-1]), paths[:-1]
        if len(paths) > TABLES:
            paths = [written(read(*paths))]
        known = read(*paths)
        only = lambda df, some: df.where(F.col("rel").isin(*some))
        moving, still = [m for m in MEETS if m in rels], [r for r in ("V", "VH", "L", "P") if r in rels]
        parts = []
        if set(rels) & set(COMPLETES):
            parts.append(_completed(waiting.where(op.isin(*{o for r in rels for o in COMPLETES.get(r, [])})), only(delta, COMPLETES)))
        if moving:
            parts.append(_met(only(delta, moving), only(known, {r for m in moving for r in MEETS[m]})))
        if still and before:
            parts.append(_met(only(read(*before), [m for m in MEETS if set(MEETS[m]) & set(still)]), only(delta, still)))
        if not parts:
            break
        made = parts[0]
        for part in parts[1:]:
            made = made.union(part)
        made = made.where("key is not null and value is not null").distinct().join(only(known, {m for r in rels for m in MAKES[r].split()}), ["rel", "key", "value"], "left_anti")
        new = made.withColumn("deep", real & deep)
    return Solution(read(*paths), hit)


def pointer_targets(known: DataFrame) -> DataFrame:
    """location, targets (sorted, comma-joined)."""
    return known.where("rel = 'P'").groupBy(F.col("key").alias("location")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("targets"))


def indirect_calls(known: DataFrame, calls: DataFrame) -> DataFrame:
    """site, caller, callee, call_kind of the calls (site, function_id) that have targets through a pointer."""
    return _resolved(calls.join(known.where("rel = 'T'").select(F.col("key").alias("site"), F.col("value").alias("callee")), "site"))


def calls_through(found: Solution, calls: DataFrame) -> DataFrame:
    """indirect_calls() from the sets: a call is paired with its targets at the very end, after all shuffles of calls."""
    return _resolved(found.members("T", calls.select(F.col("site").alias("key"), "site", "function_id")).withColumnRenamed("value", "callee"))


def _resolved(calls: DataFrame) -> DataFrame:
    return calls.select("site", F.col("function_id").alias("caller"), "callee", F.lit("INDIRECT_RESOLVED").alias("call_kind"))


def location_symbols(locations: DataFrame, variables: DataFrame) -> DataFrame:
    """location, symbol_id, access_path: the object of the longest prefix up to a slash (names may hold slashes), and the rest of the location."""
    parts = F.split("location", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    objects = variables.select("symbol_id", F.concat(F.lit("obj:"), "symbol_id").alias("prefix"))
    found = locations.select("location").distinct().select("location", F.explode(prefixes).alias("prefix")).join(objects, "prefix")
    best = found.groupBy("location").agg(F.max_by(F.struct("symbol_id", "prefix"), F.length("prefix")).alias("b"))
    return best.select("location", "b.symbol_id", F.substring("location", F.length("b.prefix") + 1, F.length("location")).alias("access_path"))


def indirect_accesses(known: DataFrame, items: DataFrame, variables: DataFrame) -> DataFrame:
    """item, symbol_id, access_path, mode of items (item, r: their location expression, mode); those without any location are UNRESOLVED_POINTEE."""
    at = items.join(known.where("rel = 'L'").select(F.col("key").alias("r"), F.col("value").alias("location")), "r", "left")
    found = at.join(location_symbols(at.where("location is not null"), variables), "location").select("item", "symbol_id", "access_path", "mode")
    none = at.where("location is null").select("item", F.lit(None).cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("access_path"), F.lit("UNRESOLVED_POINTEE").alias("mode"))
    return found.unionByName(none)
