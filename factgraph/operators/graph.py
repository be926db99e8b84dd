"""Graph closures as iterative joins; each round's new rows are cut from their lineage by a written table."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read back: its lineage ends there, and the planner sees its true size.

    checkpoint() would keep estimated sizes, which multiply from round to round.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


#: Spark deletes a query's shuffle files when it ends; else they lie beside those of all later rounds until the driver collects garbage.
END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> str:
    """The path of df, written to the shared folder. Shuffle files of the job that writes it go when it ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), f"factgraph-{spark.sparkContext.applicationId}")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    was = spark.conf.get(END_SHUFFLES, None)
    spark.conf.set(END_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(END_SHUFFLES) if was is None else spark.conf.set(END_SHUFFLES, was)
    return path


def watched(df: DataFrame, **watch) -> tuple[DataFrame, dict]:
    """checkpointed(df), and aggregates over its rows that the same job has counted."""
    seen = Observation()
    table = checkpointed(df.observe(seen, *(c.alias(k) for k, c in watch.items())))
    return table, seen.get


def call_graph_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls whose callee is defined."""
    return calls.select("caller", "callee").distinct().join(_shuffled(functions.select(F.col("function_id").alias("callee")).distinct()), "callee", "left_semi").select("caller", "callee")


#: Steps along the edges within one job, written rounds whose rows are put together in one table, and rows of a front from which on a job makes one step.
HOPS, TABLES, FRONT = 4, 4, 20_000


def _shuffled(df: DataFrame) -> DataFrame:
    """df for a join in a loop, never broadcast: a broadcast goes through the driver, in every join of every round anew."""
    return df.hint("merge")


def _proper(edges: DataFrame) -> DataFrame:
    return edges.where("caller is not null and callee is not null and caller <> callee").select("caller", "callee").distinct()


def _chains(edges: DataFrame, own: DataFrame, keep: DataFrame, join) -> DataFrame:
    """function_id, top, dist, along: functions with one caller that are not kept, and where the chain of such callers ends.

    own: function_id, along of every callee; join puts the along of two parts of
    a chain together. Pointers double, so that a chain takes rounds by the
    logarithm of its length. A cycle of such functions is cut at its least one.
    """
    single = edges.groupBy("callee").agg(F.count("*").alias("n"), F.min("caller").alias("up")).where("n = 1")
    single = checkpointed(single.select(F.col("callee").alias("function_id"), "up").join(_shuffled(keep.select("function_id").distinct()), "function_id", "left_anti").join(_shuffled(own), "function_id"))
    while True:
        at = single.select("function_id", F.col("up").alias("top"), F.lit(1).alias("dist"), "along", F.col("function_id").alias("low"))
        before = None
        while True:
            above = at.select(F.col("function_id").alias("top"), F.col("top").alias("above"), F.col("dist").alias("more"), F.col("along").alias("first"), F.col("low").alias("least"))
            both = at.join(_shuffled(above), "top", "left")
            opened = F.col("above").isNotNull()
            low = F.when(opened, F.least("low", "least")).otherwise(F.col("low"))
            at, n = watched(both.select("function_id", F.coalesce("above", "top").alias("top"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.when(opened, join(F.col("first"), F.col("along"))).otherwise(F.col("along")).alias("along"), low.alias("low"), opened.alias("open"), (low != F.col("low")).alias("moved")),
                            open=F.count_if("open"), moved=F.count_if(F.col("open") & F.col("moved")))
            if not n["open"]:
                return at.select("function_id", "top", "dist", "along")
            if n["open"] == before and not n["moved"]:
                break
            before = n["open"]
        single = checkpointed(single.join(_shuffled(at.where("open and low = function_id").select("function_id")), "function_id", "left_anti"))


def _spread(front: DataFrame, links: DataFrame, keys: list[str], best, extend, better, value: str = "value") -> list[DataFrame]:
    """Tables whose best value of each key is what the front's rows reach along the links (caller, callee, ...), HOPS steps in a job, one if the front is large.

    best: aggregate of values; extend: value at a link's end; better: whether
    the new value adds to the old one. Only rows that a job's last step has
    made better go on; earlier ones have been followed within the job. Within
    a job nothing is held against what is found, so that a large front would
    follow again what it has followed before.
    """
    found, size = [front], front.count()
    while True:
        steps, at, hops = [], front, HOPS if size <= FRONT else 1
        for hop in range(hops):
            at = at.join(_shuffled(links), F.col("function_id") == F.col("caller")).select(*[k for k in keys if k != "function_id"], F.col("callee").alias("function_id"), extend.alias(value)).groupBy(*keys).agg(best(value).alias(value))
            steps.append(at.withColumn("last", F.lit(hop == hops - 1)))
        new = reduce(DataFrame.unionByName, steps).groupBy(*keys).agg(best(F.col(value)).alias(value), best(F.when(F.col("last"), F.col(value))).alias("final"))
        if len(found) > TABLES:
            found = [checkpointed(reduce(DataFrame.unionByName, found).groupBy(*keys).agg(best(value).alias(value)))]
        old = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(best(value).alias("old"))
        new = new.join(_shuffled(old), keys, "left").where(F.col("old").isNull() | better(F.col(value), F.col("old")))
        new, n = watched(new.select(*keys, value, (F.col("final").isNotNull() & (F.col("old").isNull() | better(F.col("final"), F.col("old")))).alias("go")), go=F.count_if("go"))
        found.append(new.select(*keys, value))
        if not n["go"]:
            return found
        front, size = new.where("go").select(*keys, value), n["go"]


def closure(seeds: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """label, function_id, depth: what each label's seeds reach, with the shortest distance.

    Chains of functions with one caller are one link each, so the rounds follow
    the branching of the graph, not its depth.
    """
    edges = checkpointed(_proper(edges))
    seeds = checkpointed(seeds.select(label, "function_id").distinct())
    chains = _chains(edges, edges.select(F.col("callee").alias("function_id"), F.lit(0).alias("along")).distinct(), seeds, lambda a, b: a)
    front, links = seeds.withColumn("value", F.lit(0)), _links(edges, chains).groupBy("caller", "callee").agg(F.min("dist").alias("step"))
    found = _spread(front, checkpointed(links), [label, "function_id"], F.min, F.col("value") + F.col("step"), lambda a, b: a < b)
    tops = checkpointed(reduce(DataFrame.unionByName, found).groupBy(label, "function_id").agg(F.min("value").alias("depth")))
    below = tops.withColumnRenamed("function_id", "top").join(_shuffled(chains), "top").select(label, "function_id", (F.col("depth") + F.col("dist")).alias("depth"))
    return tops.unionByName(below).withColumn("depth", F.col("depth").cast("int"))


def _links(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """caller, callee, dist, along: edges into functions that no chain holds, from the tops of the chains that they leave."""
    ends = edges.join(_shuffled(chains.select(F.col("function_id").alias("callee"))), "callee", "left_anti")
    at = ends.join(_shuffled(chains.withColumnRenamed("function_id", "caller")), "caller", "left")
    return at.select(F.coalesce("top", "caller").alias("caller"), "callee", (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), "along")


def witness_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """context_id, function_id, path, call_depth: of the shortest paths from a context's roots the one that comes first in order."""
    edges = checkpointed(_proper(edges))
    roots = checkpointed(roots.select("context_id", "function_id").distinct())
    own = edges.select(F.col("callee").alias("function_id")).distinct().withColumn("along", F.array("function_id"))
    chains = _chains(edges, own, roots, F.concat)
    ordered = lambda path: F.struct(F.size(path).alias("n"), path.alias("path"))
    links = _links(edges, chains).withColumn("way", F.concat(F.coalesce("along", F.array().cast("array<string>")), F.array("callee")))
    links = checkpointed(links.groupBy("caller", "callee").agg(F.min(ordered(F.col("way"))).alias("way")))
    front = roots.withColumn("value", ordered(F.array("function_id")))
    found = _spread(front, links, ["context_id", "function_id"], F.min, ordered(F.concat("value.path", "way.path")), lambda a, b: a < b)
    tops = checkpointed(reduce(DataFrame.unionByName, found).groupBy("context_id", "function_id").agg(F.min("value").alias("value")).select("context_id", "function_id", "value.path"))
    below = tops.withColumnRenamed("function_id", "top").join(_shuffled(chains), "top").select("context_id", "function_id", F.concat("path", "along").alias("path"))
    return tops.unionByName(below).withColumn("call_depth", F.size("path") - 1)


def spread_masks(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, mask: the bits of all seeds (function_id, mask) that reach a function; those without a bit are left out."""
    edges = checkpointed(_proper(edges))
    seeds = checkpointed(seeds.groupBy("function_id").agg(F.bit_or("mask").alias("mask")))
    own = edges.select(F.col("callee").alias("function_id")).distinct().join(_shuffled(seeds), "function_id", "left").select("function_id", F.coalesce("mask", F.lit(0)).cast("long").alias("along"))
    none = edges.select(F.col("callee").alias("function_id")).limit(0)
    chains = _chains(edges, own, none, lambda a, b: a.bitwiseOR(b))
    links = checkpointed(_links(edges, chains).groupBy("caller", "callee").agg(F.bit_or(F.coalesce("along", F.lit(0))).alias("along")))
    front = seeds.join(_shuffled(chains), "function_id", "left_anti").select("function_id", F.col("mask").alias("value"))
    front = checkpointed(front.union(links.select("callee", "along")).groupBy("function_id").agg(F.bit_or("value").alias("value")).where("value <> 0"))
    found = _spread(front, links.select("caller", "callee"), ["function_id"], F.bit_or, F.col("value"), lambda a, b: a.bitwiseAND(F.bitwise_not(b)) != 0)
    tops = checkpointed(reduce(DataFrame.unionByName, found).groupBy("function_id").agg(F.bit_or("value").alias("mask")))
    below = chains.join(_shuffled(tops.withColumnRenamed("function_id", "top")), "top", "left").select("function_id", F.col("along").bitwiseOR(F.coalesce("mask", F.lit(0))).alias("mask"))
    return tops.unionByName(below).where("mask <> 0")


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id of the seeds and all that they reach."""
    return spread_masks(seeds.select("function_id").distinct().withColumn("mask", F.lit(1).cast("long")), edges).select("function_id")


def reach_sets(seeds: DataFrame, edges: DataFrame, label: str, bits: int = 62) -> DataFrame:
    """label, function_id: what the seeds of each label reach, for labels that are a small fixed set: bits of one mask, `bits` of them in a pass."""
    names = sorted(r[0] for r in seeds.select(label).distinct().collect())
    out = []
    for i in range(0, len(names), bits):
        part = names[i : i + bits]
        known = F.create_map(*(F.lit(x) for k, name in enumerate(part) for x in (name, 1 << k)))
        masks = checkpointed(spread_masks(seeds.where(F.col(label).isin(part)).select("function_id", known[F.col(label)].cast("long").alias("mask")), edges))
        out.append(masks.select(F.explode(F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(part))), lambda x: x.isNotNull())).alias(label), "function_id"))
    return reduce(DataFrame.union, out) if out else seeds.select(label, "function_id").limit(0)


def reach_groups(groups: dict[str, DataFrame], edges: DataFrame) -> dict[str, DataFrame]:
    """By group: label, function_id of what its seeds (label, function_id) reach. All groups are bits of one pass along the edges."""
    marked = [s.select(F.concat(F.lit(f"{g}:"), "label").alias("label"), "function_id") for g, s in groups.items()]
    seeds = checkpointed(reduce(DataFrame.union, marked).where("label is not null and function_id is not null").distinct())
    found = reach_sets(seeds, edges, "label")
    return {g: found.where(F.startswith("label", F.lit(f"{g}:"))).select(F.substring("label", F.lit(len(g) + 2), F.length("label")).alias("label"), "function_id") for g in groups}


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that stay when functions without a caller or without a callee go, again and again; and their number.

    A job peels several layers. Where layers are thin, all functions go whose
    only way in or out ends where there is none: chains of any length at once.
    """
    edges, n = watched(edges, n=F.count("*"))
    n = n["n"]
    while n:
        before, peeled = n, edges
        for _ in range(HOPS):
            peeled = peeled.join(_shuffled(peeled.select(F.col("callee").alias("caller")).distinct()), "caller", "left_semi")
            peeled = peeled.join(_shuffled(peeled.select(F.col("caller").alias("callee")).distinct()), "callee", "left_semi").select("caller", "callee")
        edges, seen = watched(peeled, n=F.count("*"))
        n = seen["n"]
        if n == before:
            break
        if n and before - n < before // 8:
            turned = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
            for side in (edges, turned):
                open_chains = _chains(side, side.select(F.col("callee").alias("function_id"), F.lit(0).alias("along")).distinct(), side.select(F.col("callee").alias("function_id")).limit(0), lambda a, b: a)
                ends = open_chains.join(_shuffled(side.select(F.col("callee").alias("top")).distinct()), "top", "left_anti").select("function_id")
                edges = edges.join(_shuffled(ends.withColumnRenamed("function_id", "caller")), "caller", "left_anti").join(_shuffled(ends.withColumnRenamed("function_id", "callee")), "callee", "left_anti").select("caller", "callee")
            edges, seen = watched(edges, n=F.count("*"))
            n = seen["n"]
    return edges, n


def _least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """function_id, label: the least function that reaches each one. A label's own label reaches it too, so labels jump ahead as well."""
    labels = checkpointed(nodes.select("function_id", F.col("function_id").alias("label")))
    while True:
        at = labels
        for _ in range(2):
            passed = edges.join(_shuffled(at), F.col("caller") == F.col("function_id")).select(F.col("callee").alias("function_id"), "label")
            at = at.union(passed).groupBy("function_id").agg(F.min("label").alias("label"))
        jump = at.select(F.col("function_id").alias("label"), F.col("label").alias("further"))
        at = at.join(_shuffled(jump), "label").select("function_id", F.least("label", "further").alias("label"))
        labels, n = watched(at.join(_shuffled(labels.withColumnRenamed("label", "was")), "function_id").select("function_id", "label", (F.col("label") != F.col("was")).alias("moved")), moved=F.count_if("moved"))
        labels = labels.select("function_id", "label")
        if not n["moved"]:
            return labels


def components(edges: DataFrame) -> DataFrame:
    """function_id, component of the functions on a cycle: the least id of their strongly connected component.

    What remains after trimming takes the least id that reaches it; those of one
    label that reach the label's own function back are its component. Found
    components leave and the rest goes round again.
    """
    left, n = _trimmed(_proper(edges))
    found = []
    while n:
        ends = left.select(F.col("caller").alias("function_id")).union(left.select("callee")).distinct()
        labels = _least_labels(ends, left)
        of = lambda side: labels.select(F.col("function_id").alias(side), F.col("label").alias(f"{side}_label"))
        back = checkpointed(left.join(_shuffled(of("caller")), "caller").join(_shuffled(of("callee")), "callee").where("caller_label = callee_label").select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
        again = _least_labels(labels.select("function_id"), back).withColumnRenamed("label", "back")
        member = checkpointed(labels.join(_shuffled(again), "function_id").where("label = back").select("function_id", F.col("label").alias("component")))
        found.append(member)
        gone = member.select("function_id")
        left, n = _trimmed(left.join(_shuffled(gone.withColumnRenamed("function_id", "caller")), "caller", "left_anti").join(_shuffled(gone.withColumnRenamed("function_id", "callee")), "callee", "left_anti").select("caller", "callee"))
    none = edges.select(F.col("caller").alias("function_id"), F.col("caller").alias("component")).limit(0)
    # A component of one function has no cycle but a call of itself, which is no edge here.
    every = reduce(DataFrame.union, found) if found else none
    return every.join(_shuffled(every.groupBy("component").count().where("count > 1").select("component")), "component", "left_semi").select("function_id", "component")


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges inside a strongly connected component, and functions that call themselves."""
    edges = edges.select("caller", "callee").distinct()
    of = components(edges)
    side = lambda name: of.select(F.col("function_id").alias(name), F.col("component").alias(f"{name}_component"))
    inside = edges.join(_shuffled(side("caller")), "caller").join(_shuffled(side("callee")), "callee").where("caller_component = callee_component").select("caller", "callee")
    return inside.union(edges.where("caller = callee")).distinct()


#: Library calls whose effect is modelled.
SUMMARISED = ["memcpy", "memmove", "memset", "memcmp", "xTaskCreate", "xTaskCreateStatic", "osThreadNew", "xTaskCreatePinnedToCore"]


def external_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """function_id, file, line, callee: one row for each site that calls undefined code whose effect is not modelled."""
    made = calls.where(F.col("call_kind").isin("DIRECT", "INDIRECT_RESOLVED") & ~F.coalesce(F.col("callee_name").isin(SUMMARISED), F.lit(False)))
    return made.join(functions.select(F.col("function_id").alias("callee")).distinct(), "callee", "left_anti").select(F.col("caller").alias("function_id"), "file", "line", F.col("callee_name").alias("callee")).distinct()


def linked_outside(functions: DataFrame) -> DataFrame:
    """label, function_id of the functions that undefined code may call."""
    return functions.where("linkage = 'EXTERNAL'").select(F.lit("").alias("label"), "function_id")


def possible_functions(seeds: DataFrame, edges: DataFrame, opaque: DataFrame, functions: DataFrame) -> DataFrame:
    """function_id of all that may run. Once a caller of undefined code runs, every function with external linkage may."""
    found = reach_groups({"start": seeds.select(F.lit("").alias("label"), "function_id"), "outside": linked_outside(functions)}, edges)
    return may_run(found["start"], found["outside"], opaque)


def may_run(reached: DataFrame, outside: DataFrame, opaque: DataFrame) -> DataFrame:
    """function_id of what is reached, and of what is reached from outside if a caller of undefined code (opaque) is."""
    reached = reached.select("function_id")
    if reached.join(opaque, "function_id", "left_semi").isEmpty():
        return reached.distinct()
    return reached.union(outside.select("function_id")).distinct()


#: Kinds of uncertainty that leave open what runs.
GAP_KINDS = [
    "PARSE_FAILED", "POINTS_TO_LIMIT", "INLINE_ASSEMBLY", "CPP_SEMANTICS_REVIEW", "MULTIPLE_BUILD_VARIANTS", "SOURCE_CHANGED_DURING_SCAN", "HEADER_CHANGED_DURING_SCAN", "UNMATCHED_CONTEXT",
    "UNRESOLVED_CONFIG_CALL", "UNRESOLVED_TASK_ENTRY", "CMSIS_V1_TASK_ENTRY", "UNRESOLVED_REGISTERED_ENTRY", "UNMATCHED_ENTRY_REGISTRATION", "ASSEMBLY_SOURCE_REVIEW", "BUILD_INCOMPLETE",
]


def reachability(functions: DataFrame, bound: DataFrame, possible: DataFrame, unknowns: DataFrame, build_complete: bool = True) -> DataFrame:
    """function_id, reachability: REACHABLE from a context; PROVEN_UNREACHABLE if nothing may run it, contexts exist and no gap leaves it open; else UNKNOWN_ENTRY."""
    closed = build_complete and not bound.isEmpty() and unknowns.where(F.col("kind").isin(GAP_KINDS)).isEmpty()
    flagged = functions.select("function_id").join(bound.select("function_id").distinct().withColumn("bound", F.lit(True)), "function_id", "left").join(possible.select("function_id").distinct().withColumn("possible", F.lit(True)), "function_id", "left")
    return flagged.select("function_id", F.when(F.col("bound"), "REACHABLE").when(F.col("possible").isNull() & F.lit(closed), "PROVEN_UNREACHABLE").otherwise("UNKNOWN_ENTRY").alias("reachability"))


def taint_seeds(unknowns: DataFrame) -> DataFrame:
    """kind, function_id: where each kind of uncertainty without a symbol starts."""
    at = F.coalesce("target_function_id", "function_id")
    return unknowns.where(F.col("symbol_id").isNull()).select("kind", at.alias("function_id")).where("function_id != ''")


def taint(unknowns: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, function_id: kinds of uncertainty without a symbol flow from their target, else their function, to all callees."""
    return reach_sets(taint_seeds(unknowns), edges, "kind")


def ancestors(seeds: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """label, function_id: the seeds and everything that calls them, directly or not."""
    return closure(seeds, edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), label).select(label, "function_id")


def ancestors_of_many(seeds: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """ancestors() of many labels with few functions each: what calls a function is followed once, not once for each label, and its set goes to the labels."""
    seeds = checkpointed(seeds.select(label, "function_id").where("function_id is not null").distinct())
    above = ancestors(seeds.select(F.col("function_id").alias("of"), "function_id").distinct(), edges, "of")
    sets = checkpointed(above.groupBy("of").agg(F.collect_list("function_id").alias("above")))
    # Rows of a label are in one partition already when they are made distinct.
    met = seeds.join(sets, F.col("function_id") == F.col("of")).select(label, "above").repartition(label)
    return met.select(label, F.explode("above").alias("function_id")).distinct()
