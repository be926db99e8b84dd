"""Queries by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.operators import access, command_line, config_check, contexts, graph, multicore, points_to, presentation, review, rules, scope, sets, text
from factgraph.plans import analysis, combine
from factgraph.sources import runs
from factgraph.sources.facts import SQL as FACT_SQL
from factgraph.sources.facts import fact, with_facts

SCOPE = scope.Scope(["brand1", "brand2", "brand12", "sup", "brand3/p1.c"], ["brand2/inc", "brand12/p"], ["brand1/p7.c"], ["brand1/p2?.c", "brand12/p3.c"])
SPECS = [{"id": "cfg:isr", "kind": "ISR", "patterns": ["T*_IRQHandler"]}, {"id": "cfg:task", "kind": "TASK", "functions": ["f10", "n3::f20", "nowhere"], "regex": ["f1[0-9]5"], "reentrant": True},
         {"id": "cfg:none", "kind": "TASK", "functions": ["missing"]}, {"id": "cfg:off", "kind": "TASK", "patterns": ["f?7"], "enabled": False}]
EDGES = [("f10", "f11"), ("main", "f3"), ("f12", "missing"), ("f20", "n3::f20")]
REGISTERED = [{"api": "my_*"}, {"api": "*_start"}, {"api": "never_*"}]
EVENT_PATTERNS = {"lock_enter": ["ext1*", "memcpy"], "lock_exit": ["ext?2", "ext1[0-5]"]}
REGIONS = [(0, 1600), (3200, 800)]



def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


FACTS = {
    "edges": "SELECT DISTINCT caller, callee FROM calls WHERE callee IN (SELECT function_id FROM functions)",
    "bound": "SELECT context_id, function_id FROM roots UNION SELECT b.context_id, e.callee FROM bound b JOIN edges e ON b.function_id = e.caller",
    "external": "SELECT DISTINCT caller AS function_id, file, line, callee_name AS callee FROM calls WHERE call_kind IN ('DIRECT', 'INDIRECT_RESOLVED') AND callee NOT IN (SELECT function_id FROM functions) AND callee_name NOT IN ('memcpy', 'memmove', 'memset', 'memcmp', 'xTaskCreate', 'xTaskCreateStatic', 'osThreadNew', 'xTaskCreatePinnedToCore')",
    "open_points": "SELECT kind, symbol_id, function_id, target_function_id, file, line FROM unknowns UNION ALL SELECT 'EXTERNAL_CALLEE', NULL, function_id, NULL, file, line FROM external",
    "starts": "SELECT function_id FROM bound UNION SELECT target_function_id FROM open_points WHERE target_function_id IS NOT NULL UNION SELECT function_id FROM functions WHERE attributed",
    "reached": "SELECT function_id FROM starts UNION SELECT e.callee FROM reached r JOIN edges e ON r.function_id = e.caller",
    "may": "SELECT function_id FROM starts UNION SELECT function_id FROM functions WHERE linkage = 'EXTERNAL' AND EXISTS (SELECT 1 FROM reached JOIN external USING (function_id)) UNION SELECT e.callee FROM may m JOIN edges e ON m.function_id = e.caller",
    "reach": "SELECT function_id, CASE WHEN function_id IN (SELECT function_id FROM bound) THEN 'REACHABLE' WHEN function_id NOT IN (SELECT function_id FROM may) AND EXISTS (SELECT 1 FROM bound) AND NOT EXISTS (SELECT 1 FROM reach_gaps) THEN 'PROVEN_UNREACHABLE' ELSE 'UNKNOWN_ENTRY' END AS reachability FROM functions",
    "reach_gaps": f"SELECT kind FROM open_points WHERE kind IN ({_list(graph.GAP_KINDS)}) UNION ALL SELECT kind FROM build_gaps WHERE kind IN ('PARSE_FAILED', 'SOURCE_NOT_IN_DATABASE')",
    "build_gaps": "SELECT NULL::VARCHAR AS kind WHERE false",
    "all_gaps": f"""SELECT coalesce(list(DISTINCT kind), []) AS kinds FROM (SELECT kind FROM open_points WHERE symbol_id IS NULL AND kind IN ({_list(k for k in rules.GLOBAL_GAPS if k != 'INLINE_ASSEMBLY')}) UNION ALL SELECT kind FROM build_gaps
  UNION ALL SELECT kind FROM open_points WHERE symbol_id IS NULL AND kind = 'INLINE_ASSEMBLY' AND coalesce(function_id, '') NOT IN (SELECT function_id FROM dead))""",
    "taints": "SELECT kind, coalesce(target_function_id, function_id) AS function_id FROM open_points WHERE symbol_id IS NULL UNION SELECT t.kind, e.callee FROM taints t JOIN edges e ON t.function_id = e.caller",
    "walk": "SELECT context_id, function_id, 0 AS depth FROM roots UNION SELECT w.context_id, e.callee, w.depth + 1 FROM walk w JOIN edges e ON w.function_id = e.caller WHERE w.depth < 40",
    "depths": "SELECT context_id, function_id, min(depth) AS depth FROM walk GROUP BY ALL",
    "dead": "SELECT function_id FROM reach WHERE reachability = 'PROVEN_UNREACHABLE'",
    "live": "SELECT * FROM accesses WHERE function_id NOT IN (SELECT function_id FROM dead)",
    "used": "SELECT DISTINCT symbol_id, access_kind, context_id FROM live JOIN bound USING (function_id)",
    "rw": """SELECT s.symbol_id, coalesce(list_sort(list(DISTINCT context_id) FILTER (access_kind IN ('READ', 'RMW'))), []) AS readers, coalesce(list_sort(list(DISTINCT context_id) FILTER (access_kind IN ('WRITE', 'RMW'))), []) AS writers,
  coalesce(list_sort(list(DISTINCT context_id) FILTER (context_id IS NOT NULL)), []) AS contexts FROM (SELECT DISTINCT symbol_id FROM accesses) s LEFT JOIN used u ON s.symbol_id = u.symbol_id GROUP BY s.symbol_id""",
    "shape": """SELECT symbol_id, count(*) AS n_live, count(DISTINCT (function_id, file, pos, access_path, access_kind)) FILTER (access_kind IN ('READ', 'WRITE', 'RMW')) AS sites, bool_or(function_id NOT IN (SELECT function_id FROM bound)) AS unknown_context,
  bool_or(access_kind = 'ADDRESS_TAKEN' OR via_alias) AS escapes, bool_or(access_kind = 'RMW') AS rmw, bool_and(access_kind = 'READ') AS only_reads, bool_or(function_id IN (SELECT function_id FROM protection_events WHERE event_kind IN ('lock_enter', 'lock_exit'))) AS locks FROM live GROUP BY symbol_id""",
    "tainted": "SELECT symbol_id, list(DISTINCT kind) AS kinds FROM live JOIN taints USING (function_id) GROUP BY symbol_id",
    "doubts": "SELECT symbol_id, bool_or(kind = 'DMA_SHARED_REVIEW') AS dma FROM open_points WHERE symbol_id IS NOT NULL AND function_id NOT IN (SELECT function_id FROM dead) GROUP BY symbol_id",
    "noted": "SELECT symbol_id, list(DISTINCT owner_context) AS owners, bool_or(business_critical) AS critical FROM variables v JOIN resources r ON r.resource IN (v.symbol_id, v.name, v.qualified_name) GROUP BY symbol_id",
    "ext_gaps": "SELECT coalesce(list(DISTINCT kind), []) AS kinds FROM open_points WHERE symbol_id IS NULL AND kind IN ('EXTERNAL_CALLEE', 'INLINE_ASSEMBLY', 'UNRESOLVED_POINTEE') AND function_id NOT IN (SELECT function_id FROM dead)",
    "wide": """SELECT v.*, coalesce(n_all, 0) AS n_all, coalesce(n_live, 0) AS n_live, coalesce(sites, 0) AS sites, coalesce(unknown_context, false) AS unknown_context, coalesce(escapes, false) AS escapes, coalesce(rmw, false) AS rmw, coalesce(only_reads, false) AS only_reads, coalesce(locks, false) AS locks,
  coalesce(readers, []) AS readers, coalesce(writers, []) AS writers, coalesce(contexts, []) AS contexts, coalesce(list_has_any(contexts, (SELECT coalesce(list(context_id), []) FROM contexts WHERE reentrant)), false) AS reentrant, doubts.symbol_id IS NOT NULL AS uncertain, coalesce(dma, false) AS dma, coalesce(owners, []) AS owners, coalesce(critical, false) AS critical,
  v.name IN (SELECT resource FROM protection) AS declared, v.symbol_id IN (SELECT symbol_id FROM snapshots) AS snapshot, coalesce(tainted.kinds, []) AS taints, v.linkage <> 'EXTERNAL' AND NOT coalesce(escapes, false) AS own, v.coverage_source <> 'compile_database' AS extra
  FROM variables v LEFT JOIN rw ON rw.symbol_id = v.symbol_id LEFT JOIN shape ON shape.symbol_id = v.symbol_id LEFT JOIN doubts ON doubts.symbol_id = v.symbol_id LEFT JOIN noted ON noted.symbol_id = v.symbol_id LEFT JOIN tainted ON tainted.symbol_id = v.symbol_id
  LEFT JOIN (SELECT symbol_id, count(*) AS n_all FROM accesses GROUP BY symbol_id) al ON al.symbol_id = v.symbol_id""",
    "ruled": """SELECT *, (len(contexts) >= 2 OR reentrant) AS shared, (len(contexts) >= 2 OR reentrant) AND len(writers) > 0 AS written FROM wide""",
    "judged": """SELECT *, list_filter([CASE WHEN parse_status = 'FAILED' THEN 'GS-PARSE-INCOMPLETE' END, CASE WHEN unknown_context THEN 'GS-UNKNOWN-CONTEXT' END, CASE WHEN escapes OR uncertain THEN 'GS-INDIRECT-ACCESS' END, CASE WHEN n_live = 0 AND NOT is_const THEN 'GS-NO-ACCESS-EVIDENCE' END,
  CASE WHEN definition_file IS NULL THEN 'GS-DEFINITION-MISSING' END, CASE WHEN dma THEN 'DMA_SHARED_REVIEW' END, CASE WHEN written THEN 'GS-MULTI-CONTEXT' END, CASE WHEN written AND (len(writers) >= 2 OR reentrant) THEN 'GS-MULTI-WRITER' END, CASE WHEN written AND rmw THEN 'GS-RMW-INTERLEAVE' END,
  CASE WHEN written AND snapshot THEN 'GS-STALE-SNAPSHOT' END, CASE WHEN written AND kind = 'LOCAL_STATIC' THEN 'GS-LOCAL-STATIC-REENTRANT' END, CASE WHEN written AND kind = 'FILE_STATIC' THEN 'GS-FILE-STATIC-SHARED' END,
  CASE WHEN written AND (size_bytes IS NULL OR size_bytes > 4 OR alignment_bytes IS NULL OR alignment_bytes < least(size_bytes, 4)) THEN 'GS-TEAR-RISK' END, CASE WHEN written AND (is_struct OR is_bitfield_container) THEN 'GS-STRUCT-INCONSISTENT' END,
  CASE WHEN len(list_filter(owners, lambda o: len(list_filter(writers, lambda w: w <> o)) > 0)) > 0 THEN 'GS-OWNER-VIOLATION' END], lambda r: r IS NOT NULL) AS found,
  list_sort(list_distinct(CASE WHEN own THEN list_filter((SELECT kinds FROM all_gaps), lambda k: k NOT IN ('SOURCE_NOT_IN_DATABASE', 'HEADERS_NOT_INCLUDED', 'PARSE_FAILED')) ELSE (SELECT kinds FROM all_gaps) END || CASE WHEN own AND parse_status = 'FAILED' THEN ['PARSE_FAILED'] ELSE [] END || CASE WHEN linkage = 'EXTERNAL' THEN (SELECT kinds FROM ext_gaps) ELSE [] END || CASE WHEN own THEN list_filter(taints, lambda k: k NOT IN ('EXTERNAL_CALLEE', 'UNRESOLVED_POINTEE', 'POINTER_DEREFERENCE')) ELSE taints END)) AS gaps FROM ruled""",
    "eased": "SELECT *, CASE WHEN n_live > 0 AND only_reads THEN list_filter(gaps, lambda k: k NOT IN ('FUNCTION_ADDRESS', 'INDIRECT_CALL')) ELSE gaps END AS effective, len(contexts) = 1 AND NOT reentrant AND NOT unknown_context AS single FROM judged",
    "screened": """SELECT *, CASE WHEN NOT extra AND NOT uncertain AND NOT escapes AND len(effective) = 0 AND len(list_filter(found, lambda r: r NOT IN ('GS-NO-ACCESS-EVIDENCE', 'GS-UNKNOWN-CONTEXT', 'GS-COVERAGE-INCOMPLETE'))) = 0 THEN
  CASE WHEN n_live = 0 THEN CASE WHEN n_all > 0 THEN 'UNREACHABLE_ACCESSORS' ELSE 'NO_RUNTIME_ACCESSES' END WHEN only_reads THEN 'ONLY_READS' WHEN single AND sites = 1 THEN 'SINGLE_ACCESS_SITE' WHEN single THEN 'SINGLE_EXECUTION_CONTEXT' END END AS reason FROM eased""",
    "final": """SELECT *, CASE WHEN extra THEN ['GS-SUPPLEMENTAL-UNANALYZED'] WHEN reason IS NOT NULL THEN [] WHEN len(found) = 0 THEN ['GS-COVERAGE-INCOMPLETE'] ELSE list_sort(found) END AS rules, CASE WHEN extra THEN ['ACCESS_NOT_ANALYZED'] WHEN reason IS NOT NULL THEN effective ELSE gaps END AS blockers FROM screened""",
    "gaps_of": "SELECT kind, file, count(*) AS n_rows, count(DISTINCT coalesce(function_id, target_function_id)) AS n_functions, min(line) AS first_line, CASE WHEN count(DISTINCT coalesce(function_id, target_function_id)) = 1 THEN min(coalesce(function_id, target_function_id)) END AS function_id FROM open_points WHERE symbol_id IS NULL GROUP BY kind, file",
    "found": """SELECT 'GS-' || substr(sha256('["' || symbol_id || '", ' || CASE WHEN extra THEN '"GS-SUPPLEMENTAL-UNANALYZED"' ELSE '["' || array_to_string(rules, '", "') || '"], [' || array_to_string(list_transform(contexts, lambda c: '"' || c || '"'), ', ') || ']' END || ']'), 1, 16) AS finding_id, symbol_id, qualified_name AS variable_name, array_to_string(rules, ',') AS rules,
  CASE WHEN NOT list_has_any(rules, ['GS-MULTI-WRITER', 'GS-RMW-INTERLEAVE', 'GS-LOCAL-STATIC-REENTRANT', 'GS-STALE-SNAPSHOT', 'GS-OWNER-VIOLATION']) THEN 'MEDIUM' WHEN critical THEN 'CRITICAL' ELSE 'HIGH' END AS risk_level, CASE WHEN shared AND NOT extra THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN extra THEN 'UNKNOWN' WHEN locks THEN 'PARTIAL' WHEN declared THEN 'DECLARED_ONLY' ELSE 'UNKNOWN' END AS protection_status FROM final WHERE len(rules) > 0""",
}
NEEDS = {
    "edges": ["calls", "functions"], "bound": ["roots", "edges"], "external": ["calls", "functions"], "open_points": ["unknowns", "external"], "starts": ["bound", "open_points", "functions"], "reached": ["starts", "edges"], "may": ["starts", "reached", "external", "edges", "functions"],
    "reach": ["functions", "bound", "may", "reach_gaps"], "build_gaps": [], "reach_gaps": ["open_points", "build_gaps"], "all_gaps": ["open_points", "build_gaps", "dead"], "taints": ["open_points", "edges"], "walk": ["roots", "edges"], "depths": ["walk"], "dead": ["reach"], "live": ["accesses", "dead"], "used": ["live", "bound"], "rw": ["accesses", "used"], "shape": ["live", "bound", "protection_events"], "tainted": ["live", "taints"],
    "doubts": ["open_points", "dead"], "noted": ["variables", "resources"], "ext_gaps": ["open_points", "dead"], "wide": ["contexts", "variables", "rw", "shape", "doubts", "noted", "tainted", "accesses", "protection", "snapshots"], "ruled": ["wide"], "judged": ["ruled", "ext_gaps", "all_gaps"], "eased": ["judged"], "screened": ["eased"],
    "final": ["screened"], "gaps_of": ["open_points"], "found": ["final"],
}


def sql(body: str, *needs: str) -> str:
    """body over the facts that it needs, each defined once and in order."""
    base: list[str] = []
    derived: dict[str, str] = {}

    def add(name):
        if name in NEEDS:
            for n in NEEDS[name]:
                add(n)
            derived.setdefault(name, FACTS[name])
        elif name not in base:
            base.append(name)

    for n in needs:
        add(n)
    return with_facts(*base) + "".join(f", {n} AS ({s})" for n, s in derived.items()) + " " + body


class Facts:
    """The facts of one folder and what is derived from them, each built at first use."""

    def __init__(self, spark, d):
        self.spark, self.d, self.made = spark, d, {}

    def __getattr__(self, name):
        if name not in self.made:
            self.made[name] = DERIVED[name](self) if name in DERIVED else fact(self.spark, self.d, name)
        return self.made[name]


def _open_points(f):
    columns = ["kind", "symbol_id", "function_id", "target_function_id", "file", "line"]
    external = f.external.select(F.lit("EXTERNAL_CALLEE").alias("kind"), F.lit(None).cast("string").alias("symbol_id"), "function_id", F.lit(None).cast("string").alias("target_function_id"), "file", "line")
    return f.unknowns.select(columns).unionByName(external)


def _flows(f):
    """What contexts, kinds of uncertainty, other starts and functions of external linkage reach, in one pass."""
    starts = f.open_points.where("target_function_id is not null").select(F.col("target_function_id").alias("function_id")).union(f.functions.where("attributed").select("function_id"))
    return graph.reach_groups({"context": f.roots.select(F.col("context_id").alias("label"), "function_id"), "kind": graph.taint_seeds(f.open_points).withColumnRenamed("kind", "label"),
                               "start": starts.select(F.lit("").alias("label"), "function_id"), "outside": graph.linked_outside(f.functions)}, f.edges)


def _possible(f):
    opaque = f.open_points.where("kind in ('EXTERNAL_CALLEE', 'INLINE_ASSEMBLY')").select("function_id").distinct()
    return graph.may_run(f.bound.select("function_id").union(f.flows["start"].select("function_id")), f.flows["outside"], opaque)


DERIVED = {
    "edges": lambda f: graph.checkpointed(graph.call_graph_edges(f.calls, f.functions)),
    "bindings": lambda f: graph.witness_paths(f.roots, f.edges),
    "flows": lambda f: _flows(f),
    "bound": lambda f: f.flows["context"].withColumnRenamed("label", "context_id"),
    "external": lambda f: graph.checkpointed(graph.external_callees(f.calls, f.functions)),
    "open_points": _open_points,
    "possible": _possible,
    "reach": lambda f: graph.checkpointed(graph.reachability(f.functions, f.bound, f.possible, f.open_points)),
    "taints": lambda f: f.flows["kind"].withColumnRenamed("label", "kind"),
    "live": lambda f: rules.live_accesses(f.accesses, f.bound, f.contexts, f.reach),
    "readers_writers": lambda f: rules.readers_writers(f.live),
    "profile": lambda f: graph.checkpointed(rules.profile(f.variables, f.live, f.open_points, f.taints, f.reach, f.snapshots, f.protection_events, f.resources, f.protection)),
    "gaps": lambda f: rules.gap_groups(f.open_points),
    "records": lambda f: review.review_records(f.findings.withColumn("rules", F.split("rule_list", ",")), review.latest(f.review_events)),
    "states": lambda f: f.variables.withColumn("audit_status", F.when(F.col("no") % 6 == 0, "SCREENED_NO_CONCURRENCY_RISK").otherwise("REVIEW_REQUIRED")),
    "directives": lambda f: text.directives(f.sources),
    "branches": lambda f: text.file_branches(f.sources),
    "made_contexts": lambda f: contexts.registered(f.registrations, f.functions, f.configured[1], f.configured[2]),
    "configured": lambda f: contexts.configured_contexts(f.functions, SPECS),
    "linked_ids": lambda f: multicore.linked_objects(f.linked.distinct(), multicore.elf_objects(f.elf).withColumnRenamed("path", "variant"), REGIONS),
    "source_lines": lambda f: f.documents.select(F.concat(F.lit("d"), "doc_id").alias("file"), F.posexplode(F.split("text", "\n"))).select("file", (F.col("pos") + 1).alias("line"), F.col("col").alias("text")),
    "evidence": lambda f: f.documents.where("text is not null").select(F.col("doc_id").alias("ref"), F.when(F.col("doc_id") % 11 == 0, "none").otherwise(F.concat(F.lit("d"), "doc_id")).alias("file"), (F.col("doc_id") % 4).cast("int").alias("line"), F.expr("substring(text, 1 + doc_id % 7, 5)").alias("quote")),
    "unit_rows": lambda f: f.units.select("tu", "file", F.array("header").alias("includes"), "parse_status"),
    "stored_accesses": lambda f: graph.checkpointed(f.accesses.select([c.split()[0] for c in analysis.TABLES["accesses"].split(", ")])),
    "stored_snapshots": lambda f: f.spark.sql(FACT_SQL["snapshots"], accesses=f.stored_accesses),
    "solved": lambda f: points_to.solution(pointer_program(f)),
    "run": lambda f: analysis_run(f),
    "combined": lambda f: two_cores(f),
    "review_runs": lambda f: f.review_events.withColumn("run_id", F.concat(F.lit("r"), F.col("seq") % 3)),
    "response_files": lambda f: f.nation.select(F.concat(F.lit("/w/build/r"), "n_nationkey", F.lit(".rsp")).alias("path"), F.concat(F.lit("-DR="), "n_nationkey", F.lit(" @nested.rsp\n-DLAST")).alias("content")).union(
        f.spark.createDataFrame([("/w/build/nested.rsp", "'two words'"), ("/w/build/loop.rsp", "-DX @../build/loop.rsp")], "path string, content string")),
}


def pointer_program(f):
    """Instructions derived from customers: pointers to objects, copies, fields, loads and calls."""
    c = f.customer.select(F.col("c_custkey").alias("k"))
    n = f.customer.count()
    k, other = F.col("k"), (F.col("k") * 31 + 7) % n
    row = lambda op, r, x=None, name=None: F.struct(F.lit(op).alias("op"), r.alias("r"), (F.lit(None).cast("string") if x is None else x).alias("x"), (F.lit(None).cast("string") if name is None else name).alias("name"))
    e = lambda s: F.concat(F.lit(s), k)
    return c.select(F.inline(F.array(
        row("LOC", e("p"), None, F.concat(F.lit("local:p"), k)), row("LOC", e("o"), None, F.concat(F.lit("obj:P"), k % 97)), row("ADDR", e("a"), e("o")), row("ASSIGN", e("p"), e("a")),
        row("LOC", e("q"), None, F.concat(F.lit("local:p"), other)), row("READ", e("v"), e("q")), row("LOC", e("r"), None, F.concat(F.lit("local:r"), k)), row("ASSIGN", e("r"), e("v")),
        row("DEREF", e("d"), e("v")), row("FIELD", e("f"), e("d"), F.concat(F.lit("f"), k % 3)), row("FUN", e("fn"), None, F.concat(F.lit("F"), other)), row("ASSIGN", e("f"), e("fn")),
        row("READ", e("w"), e("f")), row("CALLEE", e("c"), e("w")), row("ARG", e("c"), e("a"), F.lit("0")), row("RESULT", e("c"), e("r")),
        row("LOC", e("ret"), None, F.concat(F.lit("F"), k, F.lit(":return"))), row("ASSIGN", e("ret"), e("a")))))


RUN = analysis.Config(
    contexts=[s for s in SPECS if s["id"] != "cfg:none"], call_edges=[("f10", "f11"), ("f12", "f53")],
    registrations=[{"api": "my_*", "callback_arg": 1, "kind": "ISR", "context_id": "grouped", "may_repeat": False}])


def analysis_run(f):
    """A run over all facts, with the pointer facts beside the ones that the other queries use."""
    given = {t: getattr(f, t) for t in ("variables", "functions", "accesses", "calls", "unknowns", "protection_events", "snapshots", "resources", "protection", "constraints", "semantic_calls", "indirect_accesses")}
    given |= {"accesses": f.stored_accesses, "snapshots": f.stored_snapshots}
    return analysis.Run(f.spark, given, RUN)


def joined(df, *arrays):
    return df.withColumns({a: F.array_join(a, ",") for a in arrays})


BUILDS: dict = {}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, build, body=None, *needs):
    """Registers build(Facts) under a name, with the body of its SQL over the facts that it needs."""
    BUILDS[name] = build
    QUERIES[name] = lambda spark, d: build(Facts(spark, d))
    if body:
        SQL[name] = sql(body, *needs) if needs else body


# Graph
query("call_graph_edges", lambda f: f.edges, "SELECT caller, callee FROM edges", "edges")
query("context_bindings", lambda f: f.bindings.select("context_id", "function_id", "call_depth"), "SELECT context_id, function_id, depth::INTEGER AS call_depth FROM depths", "depths")
query("context_paths", lambda f: joined(f.bindings.select("context_id", "function_id", "path"), "path"),
      "SELECT context_id, function_id, array_to_string(path, ',') AS path FROM paths".replace("SELECT", ", paths AS (SELECT context_id, function_id, 0 AS depth, [function_id] AS path FROM roots UNION SELECT w.context_id, w.function_id, w.depth, list_append(p.path, w.function_id) FROM paths p JOIN edges e ON e.caller = p.function_id JOIN depths w ON w.context_id = p.context_id AND w.function_id = e.callee AND w.depth = p.depth + 1) SELECT", 1)
      .replace("array_to_string(path, ',') AS path FROM paths", "array_to_string(min(path), ',') AS path FROM paths GROUP BY context_id, function_id"), "depths")
query("cyclic_edges", lambda f: graph.cyclic_edges(f.edges), ", reach_all(a, b) AS (SELECT DISTINCT callee, callee FROM edges UNION SELECT r.a, e.callee FROM reach_all r JOIN edges e ON r.b = e.caller) SELECT caller, callee FROM edges JOIN reach_all ON callee = a AND caller = b", "edges")
query("external_callees", lambda f: f.external, "SELECT * FROM external", "external")
query("possible_functions", lambda f: f.possible, "SELECT function_id FROM may", "may")
query("reachability", lambda f: f.reach, "SELECT * FROM reach", "reach")
query("unreachable_functions", lambda f: f.reach.where("reachability = 'PROVEN_UNREACHABLE'").select("function_id"), "SELECT function_id FROM dead", "dead")
query("taint", lambda f: f.taints, "SELECT kind, function_id FROM taints", "taints")
query("scope_relevant_functions", lambda f: graph.ancestors(f.accesses.join(scope.select_variables(f.variables, SCOPE), "symbol_id", "left_semi").select(F.lit(1).alias("any"), "function_id"), f.edges, "any").select("function_id"),
      ", kept AS (SELECT DISTINCT function_id FROM accesses WHERE symbol_id IN (SELECT symbol_id FROM in_scope)), up AS (SELECT function_id FROM kept UNION SELECT e.caller FROM up u JOIN edges e ON e.callee = u.function_id) SELECT function_id FROM up".replace(", kept", ", {scope}, kept", 1), "edges", "accesses", "variables")
query("finding_ancestors", lambda f: graph.ancestors_of_many(f.accesses.where("access_kind <> 'READ'").select(F.col("symbol_id").alias("finding_id"), "function_id"), f.edges, "finding_id"),
      ", up AS (SELECT DISTINCT symbol_id AS finding_id, function_id FROM accesses WHERE access_kind <> 'READ' UNION SELECT u.finding_id, e.caller FROM up u JOIN edges e ON e.callee = u.function_id) SELECT * FROM up", "edges", "accesses")

# Rules
query("var_readers_writers", lambda f: joined(f.readers_writers, "readers", "writers", "contexts"), "SELECT symbol_id, array_to_string(readers, ',') AS readers, array_to_string(writers, ',') AS writers, array_to_string(contexts, ',') AS contexts FROM rw", "rw")
query("variable_rules", lambda f: f.profile.select("symbol_id", F.explode("rules").alias("rule")), "SELECT symbol_id, unnest(rules) AS rule FROM final", "final")
query("findings_by_rule", lambda f: f.profile.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n_findings")), "SELECT rule, count(*) AS n_findings FROM (SELECT unnest(rules) AS rule FROM final) GROUP BY rule", "final")
query("screening", lambda f: joined(f.profile.select("symbol_id", "audit_status", "screening_reason", "blockers"), "blockers"),
      "SELECT symbol_id, CASE WHEN extra THEN 'SUPPLEMENTAL_INVENTORY' WHEN reason IS NOT NULL THEN 'SCREENED_NO_CONCURRENCY_RISK' ELSE 'REVIEW_REQUIRED' END AS audit_status, reason AS screening_reason, array_to_string(list_sort(blockers), ',') AS blockers FROM final", "final")
query("findings", lambda f: joined(rules.findings(f.profile).select("finding_id", "symbol_id", "variable_name", "rules", "risk_level", "confidence", "protection_status"), "rules"), "SELECT * FROM found", "found")
query("gap_groups", lambda f: f.gaps, "SELECT * FROM gaps_of", "gaps_of")
query("all_findings", lambda f: joined(rules.findings(f.profile).unionByName(rules.gap_findings(f.gaps)).select("finding_id", "symbol_id", "variable_name", "rules", "risk_level"), "rules"),
      "SELECT finding_id, symbol_id, variable_name, rules, risk_level FROM found UNION ALL SELECT 'GAP-' || substr(sha256(kind || '|' || coalesce(file, '')), 1, 16), NULL, kind, kind, 'MEDIUM' FROM gaps_of", "found", "gaps_of")
query("accountability", lambda f: rules.accountability(f.profile), "SELECT count(*) AS total, count(reason) AS screened, count(*) FILTER (len(rules) > 0) AS queued FROM final", "final")
query("coverage_metrics", lambda f: f.profile.agg(F.count("*").alias("total"), F.count_if(F.col("parse_status") == "FAILED").alias("failed"), F.sum(F.col("n_all") - F.col("n_live")).alias("unreachable_accesses"), F.count_if(F.col("coverage_source") != "compile_database").alias("supplemental"), F.round(100 * F.count_if(F.size("contexts") > 0) / F.greatest(F.count("*"), F.lit(1)), 2).alias("context_percent")),
      "SELECT count(*) AS total, count(*) FILTER (parse_status = 'FAILED') AS failed, sum(n_all - n_live)::BIGINT AS unreachable_accesses, count(*) FILTER (extra) AS supplemental, round(100 * count(*) FILTER (len(contexts) > 0 AND NOT extra) / greatest(count(*), 1), 2) AS context_percent FROM final", "final")
query("inventory_by_kind", lambda f: f.variables.groupBy("kind").agg(F.count("*").alias("n_variables")), "SELECT kind, count(*) AS n_variables FROM variables GROUP BY kind", "variables")
query("access_sites", lambda f: f.accesses.where("access_kind in ('READ', 'WRITE', 'RMW')").groupBy("symbol_id").agg(F.count_distinct("function_id", "file", "pos", "access_path", "access_kind").alias("n_sites")),
      "SELECT symbol_id, count(DISTINCT (function_id, file, pos, access_path, access_kind)) AS n_sites FROM accesses WHERE access_kind <> 'ADDRESS_TAKEN' GROUP BY symbol_id", "accesses")
query("access_contexts", lambda f: rules.access_contexts(f.accesses, f.bound), "SELECT access_id, symbol_id, function_id, coalesce(contexts, '') AS contexts FROM accesses LEFT JOIN (SELECT function_id, string_agg(context_id, ',' ORDER BY context_id) AS contexts FROM bound GROUP BY function_id) USING (function_id)", "accesses", "bound")
query("context_pairs", lambda f: rules.context_pairs(f.readers_writers), ", u AS (SELECT DISTINCT symbol_id, context_id FROM used) SELECT x.symbol_id, x.context_id AS first, y.context_id AS second FROM u x JOIN u y ON x.symbol_id = y.symbol_id AND x.context_id < y.context_id", "used")
query("configured_pairs", lambda f: rules.configured_pairs(f.readers_writers, f.spark.createDataFrame([("C0", "C2"), ("C4", "C1"), ("C9", "C1")], "higher string, lower string")),
      "SELECT x.symbol_id, x.context_id AS higher, y.context_id AS lower FROM (SELECT DISTINCT symbol_id, context_id FROM used) x JOIN (SELECT DISTINCT symbol_id, context_id FROM used) y ON x.symbol_id = y.symbol_id WHERE (x.context_id, y.context_id) IN (('C0', 'C2'), ('C4', 'C1'))", "used")
query("entry_distance", lambda f: rules.entry_distance(f.accesses, f.bindings), "SELECT symbol_id, context_id, min(depth) + 1 AS entry_distance FROM accesses JOIN depths USING (function_id) GROUP BY symbol_id, context_id", "accesses", "depths")
query("protection_evidence", lambda f: rules.protection_evidence(f.accesses, f.protection_events), "SELECT symbol_id, function_id, coalesce(n, 0) AS n_events FROM (SELECT DISTINCT symbol_id, function_id FROM accesses) LEFT JOIN (SELECT function_id, count(*) AS n FROM protection_events WHERE event_kind <> 'dma_start' GROUP BY function_id) USING (function_id)", "accesses", "protection_events")
query("annotations", lambda f: rules.annotations(f.variables, f.resources), "SELECT DISTINCT symbol_id, owner_context, business_critical FROM variables v JOIN resources r ON r.resource IN (v.symbol_id, v.name, v.qualified_name)", "variables", "resources")
query("rule_tear_risk", lambda f: f.variables.select("symbol_id", rules.tear_risk().alias("tear_risk")), "SELECT symbol_id, size_bytes IS NULL OR size_bytes > 4 OR alignment_bytes IS NULL OR alignment_bytes < least(size_bytes, 4) AS tear_risk FROM variables", "variables")
query("merge_variables", lambda f: rules.merge_variables(f.variable_parts), """SELECT symbol_id, arg_min(kind, part_ord) AS kind, arg_min(size_bytes, part_ord) FILTER (defined) AS size_bytes, bool_or(parse_failed) AS parse_failed, count(*) AS n_units, count(DISTINCT type) > 1 AS type_variant,
  CASE WHEN count(DISTINCT declaration) = 1 THEN min(declaration) ELSE arg_min(declaration, part_ord) || ',' || arg_max(declaration, part_ord) END AS declarations FROM variable_parts GROUP BY symbol_id""", "variable_parts")
query("merge_functions", lambda f: rules.merge_functions(f.function_parts), "SELECT function_id, arg_max(name, part_ord) AS name, arg_max(file, part_ord) AS file FROM function_parts GROUP BY function_id", "function_parts")
query("snapshot_scenario", lambda f: review.snapshot_witness(f.accesses, f.snapshots, f.bindings, f.contexts),
      """, kinds AS (SELECT function_id, context_id, depth, kind FROM depths JOIN contexts USING (context_id)), r AS (SELECT a.*, k.context_id AS main FROM accesses a JOIN kinds k ON a.function_id = k.function_id AND k.kind = 'MAIN' WHERE access_kind = 'READ' AND (symbol_id, a.function_id) IN (SELECT (symbol_id, function_id) FROM snapshots)),
  rw3 AS (SELECT r.symbol_id, r.main, r.access_id AS read_id, r.line AS read_line, r.access_path, r.function_id, r.file, w.line AS write_line, w.access_id AS write_id FROM r JOIN accesses w ON w.access_kind = 'WRITE' AND w.symbol_id = r.symbol_id AND w.function_id = r.function_id AND w.file = r.file AND w.access_path = r.access_path AND w.line > r.line),
  riv AS (SELECT symbol_id, access_path, k.context_id AS rival, access_id AS rival_id, row_number() OVER (PARTITION BY symbol_id, access_path ORDER BY depth, k.context_id, access_id) AS nth FROM accesses a JOIN kinds k ON a.function_id = k.function_id AND k.kind = 'ISR' WHERE access_kind IN ('WRITE', 'RMW'))
  SELECT symbol_id, main, read_id, rival, rival_id, write_id FROM (SELECT rw3.*, rival, rival_id FROM rw3 JOIN riv ON riv.symbol_id = rw3.symbol_id AND riv.access_path = rw3.access_path AND nth = 1) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY read_line, read_id, main, rival, rival_id, write_line, write_id) = 1""", "accesses", "snapshots", "depths", "contexts")
query("cross_core", lambda f: multicore.cross_core(f.linked_ids, f.spark.createDataFrame([("core0", "m7"), ("core1", "m4")], "variant string, core string")), "SELECT combined_id, n_cores, 'GS-CROSS-CORE' AS rule FROM (SELECT combined_id, count(DISTINCT variant) AS n_cores FROM ids WHERE shared GROUP BY combined_id) WHERE n_cores > 1".replace("SELECT", ", {core} SELECT", 1), "linked", "elf")
query("shared_region", lambda f: f.linked_ids, ", {core} SELECT variant, symbol_id, combined_id, shared FROM ids", "linked", "elf")
query("id_remap", lambda f: multicore.remap(f.linked.select("variant", "symbol_id", "name").union(f.linked.select("variant", F.concat("symbol_id", F.lit("x")), "name")), f.linked_ids).groupBy("symbol_id").agg(F.count("*").alias("n")),
      ", {core} SELECT coalesce(combined_id, r.variant || '::' || r.symbol_id) AS symbol_id, count(*) AS n FROM (SELECT variant, symbol_id FROM linked UNION ALL SELECT variant, symbol_id || 'x' FROM linked) r LEFT JOIN ids ON ids.variant = r.variant AND ids.symbol_id = r.symbol_id GROUP BY 1", "linked", "elf")
query("elf_objects", lambda f: multicore.elf_objects(f.elf), "SELECT path, name, address, size, binding, coalesce(f, '') AS file FROM (SELECT *, last_value(CASE WHEN type = 4 THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord) AS f FROM elf) WHERE type = 1 AND defined AND size > 0", "elf")

# Scope
query("relative_path", lambda f: f.variables.select("symbol_id", scope.relative_path(F.concat(F.when(F.col("no") % 2 == 0, "/w/").otherwise("/work/"), F.replace("declaration_file", F.lit("/"), F.lit("\\"))), "/w").alias("path")),
      "SELECT symbol_id, CASE WHEN no % 2 = 0 THEN declaration_file ELSE '/work/' || declaration_file END AS path FROM variables", "variables")
query("scope_contains", lambda f: f.variables.select("symbol_id", scope.contains(F.col("definition_file"), SCOPE).alias("inside")), ", {scope} SELECT symbol_id, coalesce(def_in, false) AS inside FROM scoped", "variables")
query("scope_exclusion_reason", lambda f: f.variables.select("symbol_id", scope.exclusion_reason(F.col("definition_file"), SCOPE).alias("reason")), ", {scope} SELECT symbol_id, def_ex AS reason FROM scoped", "variables")
query("scope_variable", lambda f: f.variables.select("symbol_id", scope.variable_reason(SCOPE).alias("reason")), ", {scope} SELECT symbol_id, reason FROM scoped", "variables")
query("scope_select", lambda f: f.accesses.join(scope.select_variables(f.variables, SCOPE), "symbol_id", "left_semi").select("access_id", "symbol_id"), ", {scope} SELECT access_id, symbol_id FROM accesses WHERE symbol_id IN (SELECT symbol_id FROM in_scope)", "accesses", "variables")
query("scope_exclusion_counts", lambda f: scope.exclusion_counts(f.variables, SCOPE), ", {scope} SELECT coalesce(definition_file, declaration_file) AS file, reason, count(*) AS n_variables FROM scoped WHERE reason IS NOT NULL GROUP BY ALL", "variables")
query("scope_leaks", lambda f: scope.leaks(f.findings.where("symbol_id is not null").select("finding_id", "symbol_id"), f.variables, SCOPE), ", {scope} SELECT symbol_id, finding_id FROM findings WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT symbol_id FROM in_scope)", "findings", "variables")
query("scope_unknowns", lambda f: scope.keep_unknowns(f.unknowns, scope.select_variables(f.variables, SCOPE), f.accesses.join(scope.select_variables(f.variables, SCOPE), "symbol_id", "left_semi"), SCOPE).groupBy("kind", "kept").agg(F.count("*").alias("n")),
      ", {scope}, rel AS (SELECT DISTINCT function_id FROM accesses WHERE symbol_id IN (SELECT symbol_id FROM in_scope)) SELECT kind, CASE WHEN symbol_id IS NOT NULL THEN symbol_id IN (SELECT symbol_id FROM in_scope) ELSE function_id IN (SELECT function_id FROM rel) OR coalesce(target_function_id IN (SELECT function_id FROM rel), false) END AS kept, count(*) AS n FROM unknowns GROUP BY ALL", "unknowns", "accesses", "variables")

# Contexts
query("context_match", lambda f: contexts.match_specs(f.functions, [(s["id"], s) for s in SPECS]),
      ", named AS (SELECT function_id, unnest([name, qualified_name, function_id, file || '::' || name]) AS n FROM functions) SELECT DISTINCT spec, function_id FROM named JOIN (VALUES ('cfg:isr', 'T.*_IRQHandler'), ('cfg:task', 'f10|n3::f20|nowhere|f1[0-9]5'), ('cfg:none', 'missing'), ('cfg:off', 'f.7')) s(spec, p) ON regexp_full_match(n, p)", "functions")
query("configured_edges", lambda f: contexts.configured_edges(f.functions, EDGES),
      ", named AS (SELECT function_id, unnest(list_distinct([name, qualified_name, function_id, file || '::' || name])) AS n FROM functions), one AS (SELECT n, min(function_id) AS id FROM named GROUP BY n HAVING count(*) = 1) SELECT edge, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN a.id END AS caller, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN b.id END AS callee, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'CONFIGURED' ELSE 'UNRESOLVED_CONFIG_CALL' END AS kind FROM (VALUES (0, 'f10', 'f11'), (1, 'main', 'f3'), (2, 'f12', 'missing'), (3, 'f20', 'n3::f20')) e(edge, x, y) LEFT JOIN one a ON a.n = x LEFT JOIN one b ON b.n = y", "functions")
query("auto_entry_kind", lambda f: f.functions.select("function_id", contexts.auto_entry_kind().alias("kind")),
      "SELECT function_id, CASE WHEN NOT starts_with(name, 'HAL_') AND parameter_count = 0 AND (ends_with(name, 'IRQHandler') OR name IN ('SysTick_Handler', 'PendSV_Handler', 'SVC_Handler', 'NMI_Handler', 'HardFault_Handler', 'MemManage_Handler', 'BusFault_Handler', 'UsageFault_Handler')) THEN 'ISR' WHEN name = 'main' THEN 'MAIN' END AS kind FROM functions", "functions")
query("auto_contexts", lambda f: contexts.auto_contexts(f.functions, f.configured[1].select("function_id").union(f.configured[2])),
      ", {cfg}, k AS (SELECT function_id, name, CASE WHEN NOT starts_with(name, 'HAL_') AND parameter_count = 0 AND (ends_with(name, 'IRQHandler') OR name = 'SysTick_Handler') THEN 'ISR' WHEN name = 'main' THEN 'MAIN' END AS kind FROM functions) SELECT 'auto:' || name || ':' || substr(sha256(chr(34) || function_id || chr(34)), 1, 8) AS context_id, kind, function_id FROM k WHERE kind IS NOT NULL AND function_id NOT IN (SELECT function_id FROM cfg)", "functions")
query("registration_contexts", lambda f: contexts.registration_contexts(f.made_contexts), ", {cfg}, {made} SELECT context_id, kind, bool_or(may_repeat) AS reentrant, count(*) AS n_registrations FROM made WHERE context_id IS NOT NULL GROUP BY context_id, kind", "functions", "registrations")
query("registration_ordinal", lambda f: f.made_contexts.select("ord", "function_id", "ordinal"), ", {cfg}, {made} SELECT ord, function_id, ordinal FROM made", "functions", "registrations")
query("registration_conflicts", lambda f: f.made_contexts.where("context_id is null").select("ord", "given_id", "kind"), ", {cfg}, {made} SELECT ord, given_id, kind FROM made WHERE context_id IS NULL", "functions", "registrations")
query("undefined_entries", lambda f: contexts.undefined_entries(f.registrations, f.functions), "SELECT 'TASK_ENTRY_WITHOUT_DEFINITION' AS kind, function_id AS target_function_id, file, ord FROM registrations WHERE function_id NOT IN (SELECT function_id FROM functions)", "registrations", "functions")
query("registration_match", lambda f: contexts.match_registrations(f.arguments.select("site", "name"), REGISTERED)[0],
      "SELECT site, name, spec, how FROM (SELECT site, name, unnest(CASE name WHEN 'my_dma_start' THEN ['spec0', 'spec1'] WHEN 'xTaskCreate' THEN ['xTaskCreate'] ELSE [] END) AS spec, CASE name WHEN 'my_dma_start' THEN 'AMBIGUOUS' ELSE 'BUILT_IN' END AS how FROM arguments)", "arguments")
query("registration_unmatched", lambda f: contexts.match_registrations(f.arguments.select("site", "name"), REGISTERED)[1], "SELECT 'spec2' AS spec, 'never_*' AS api")

# Points-to
query("points_to", lambda f: points_to.pointer_targets(f.solved.known))
query("points_to_limit", lambda f: f.spark.createDataFrame([("POINTS_TO_LIMIT",)] if f.solved.hit else [], "kind string"))
query("indirect_calls", lambda f: points_to.calls_through(f.solved, f.customer.select(F.concat(F.lit("c"), "c_custkey").alias("site"), F.concat(F.lit("F"), "c_custkey").alias("function_id"))))
query("indirect_accesses", lambda f: points_to.indirect_accesses(f.solved.known, f.customer.select("c_custkey", F.concat(F.lit("f"), "c_custkey").alias("r"), F.lit("WRITE").alias("mode")).withColumnRenamed("c_custkey", "item"), f.variables))
query("location_symbol", lambda f: points_to.location_symbols(f.locations, f.variables), "SELECT location, symbol_id, substr(location, length(symbol_id) + 5) AS access_path FROM locations JOIN variables ON location = 'obj:' || symbol_id OR starts_with(location, 'obj:' || symbol_id || '/')", "locations", "variables")

# A run from facts to findings
query("analysis_run", lambda f: joined(f.run.findings.select("finding_id", "symbol_id", "variable_name", "rules", "contexts", "blockers", "risk_level", "confidence", "protection_status"), "rules", "contexts", "blockers"))
query("contexts_built", lambda f: f.run.contexts)
query("run_bindings", lambda f: joined(f.run.bindings, "path"))
query("run_accesses", lambda f: f.run.accesses)
query("run_unknowns", lambda f: f.run.unknowns.groupBy("kind").agg(F.count("*").alias("n_rows"), F.count_distinct("function_id").alias("n_functions")))
query("run_coverage", lambda f: f.run.coverage())

def two_cores(f):
    """The facts as two cores' scans: each has the accesses of its own half of the places; their images share some objects."""
    tables = {t: getattr(f, t) for t in ("variables", "functions", "calls", "unknowns", "protection_events", "roots")} | {"accesses": f.stored_accesses, "snapshots": f.stored_snapshots}
    tables["contexts"] = f.contexts.withColumn("discovery", F.lit("configured"))
    objects = multicore.elf_objects(f.elf)
    variants = {v: combine.Variant(core, tables | {"accesses": tables["accesses"].where(F.col("pos") % 2 == k)}, objects.where(F.col("path") == f"core{k}")) for k, (v, core) in enumerate((("a", "m7"), ("b", "m4")))}
    return combine.Combined(f.spark, variants, REGIONS)


query("combined_findings", lambda f: joined(f.combined.findings().select("finding_id", "symbol_id", "variable_name", "rules", "risk_level"), "rules"))
query("combined_instances", lambda f: f.combined.instances(),
      f""", o AS (SELECT path, name, address, size, binding, coalesce(f, '') AS file FROM (SELECT *, last_value(CASE WHEN type = 4 THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord) AS f FROM elf) WHERE type = 1 AND defined AND size > 0),
  v AS (SELECT variant, core, path, symbol_id, name, coalesce(regexp_extract(definition_file, '([^/]*)$', 1), '') AS base FROM variables, (VALUES ('a', 'm7', 'core0'), ('b', 'm4', 'core1')) x(variant, core, path)), m AS (SELECT variant, symbol_id, min(address) AS address, min(size) AS size FROM v JOIN o USING (path, name) WHERE binding <> 0 OR regexp_extract(file, '([^/]*)$', 1) = base GROUP BY variant, symbol_id HAVING count(*) = 1)
  SELECT CASE WHEN {' OR '.join(f'address >= {s} AND address + size <= {s + n}' for s, n in REGIONS)} THEN 'shared:0x' || lower(to_hex(address)) || ':' || size ELSE v.variant || '::' || v.symbol_id END AS combined_id, v.variant, v.core, v.symbol_id FROM v LEFT JOIN m ON m.variant = v.variant AND m.symbol_id = v.symbol_id""", "elf", "variables")

# Syntax, calls and library arguments
_WAY = """, s AS (SELECT ref, min(distance) FILTER (NOT ({passed})) AS place FROM ancestors GROUP BY ref), w AS (SELECT a.ref, coalesce(string_agg(CASE kind WHEN 'MEMBER' THEN name ELSE '[]' END, '.' ORDER BY distance DESC) FILTER (kind <> 'WRAPPER'), '') AS path,
  coalesce(max(distance) FILTER (decays), -1) > coalesce(max(distance) FILTER (kind = 'SUBSCRIPT'), -1) AS decayed FROM ancestors a JOIN s USING (ref) WHERE place IS NULL OR distance < place GROUP BY a.ref), e AS (SELECT s.ref, a.* EXCLUDE (ref), coalesce(w.path, '') AS path, coalesce(decayed, false) AS decayed FROM s LEFT JOIN ancestors a ON a.ref = s.ref AND a.distance = s.place LEFT JOIN w ON w.ref = s.ref)"""
_COMPOUND = ", ".join(f"'{o}'" for o in access.COMPOUND)
query("access_mode", lambda f: access.access_mode(f.ancestors),
      _WAY.replace("{passed}", "kind = 'WRAPPER' OR kind = 'MEMBER' AND NOT arrow OR kind = 'SUBSCRIPT' AND child = 0") + f""" SELECT ref, CASE WHEN kind = 'SIZEOF' THEN NULL WHEN kind = 'UNARY' AND op IN ('++', '--') THEN 'RMW' WHEN kind = 'UNARY' AND op = '&' THEN 'ADDRESS_TAKEN' WHEN kind = 'BINARY' AND child = 0 AND op = '=' THEN CASE WHEN same_symbol THEN 'RMW' ELSE 'WRITE' END
  WHEN kind = 'BINARY' AND child = 0 AND op IN ({_COMPOUND}) THEN 'RMW' WHEN kind = 'CALL' AND is_array AND path = '' THEN 'ADDRESS_TAKEN' WHEN kind IN ('MEMBER', 'SUBSCRIPT') THEN 'READ' WHEN decayed THEN 'ADDRESS_TAKEN' ELSE 'READ' END AS mode, CASE WHEN coalesce(kind, '') = 'SIZEOF' THEN '' ELSE path END AS path FROM e""", "ancestors")
query("indirect_mode", lambda f: access.indirect_mode(f.ancestors),
      _WAY.replace("{passed}", "kind IN ('WRAPPER', 'MEMBER') OR kind = 'SUBSCRIPT' AND child = 0") + f""" SELECT ref, CASE WHEN kind = 'SIZEOF' THEN NULL WHEN kind = 'UNARY' AND op IN ('++', '--') THEN 'RMW' WHEN kind = 'UNARY' AND op = '&' THEN 'ADDRESS_TAKEN' WHEN kind = 'BINARY' AND child = 0 AND op = '=' THEN 'WRITE' WHEN kind = 'BINARY' AND child = 0 AND op IN ({_COMPOUND}) THEN 'RMW' ELSE 'READ' END AS mode FROM e""", "ancestors")
_KINDS = {u: "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in t.items()) + "}" for u, t in ((True, access.UNARY_KINDS), (False, access.BINARY_KINDS))}
query("operator_kind", lambda f: f.lineitem.select("l_orderkey", "l_linenumber", access.operator_text(F.col("l_suppkey") % 36, F.col("l_partkey") % 3 == 0).alias("op")).groupBy("l_orderkey", "op").agg(F.count("*").alias("n")),
      f"SELECT l_orderkey, coalesce(CASE WHEN l_partkey % 3 = 0 THEN {_KINDS[True]}[l_suppkey % 36] ELSE {_KINDS[False]}[l_suppkey % 36] END, '') AS op, count(*) AS n FROM lineitem GROUP BY 1, 2".replace("[l_suppkey % 36]", "[(l_suppkey % 36)::INTEGER]"))
query("protection_events", lambda f: access.protection_kinds(f.calls.select(F.col("caller").alias("function_id"), F.col("callee_name").alias("name")), EVENT_PATTERNS),
      "SELECT caller AS function_id, callee_name AS name, k AS event_kind FROM calls JOIN (VALUES ('lock_enter', 'ext1.*|memcpy'), ('lock_exit', 'ext.2|ext1[0-5]')) p(k, r) ON regexp_full_match(callee_name, r)", "calls")
query("api_semantics", lambda f: access.argument_accesses(f.arguments), "SELECT site, arg, location, CASE WHEN name = 'memcpy' AND arg = 1 THEN 'READ' ELSE 'WRITE' END AS mode FROM arguments WHERE name = 'memcpy' AND arg < 2 OR name = 'memset' AND arg = 0", "arguments")
query("dma_contracts", lambda f: access.dma_accesses(f.arguments), "SELECT site, location, CASE name WHEN 'HAL_UART_Receive_DMA' THEN 'WRITE' ELSE 'READ' END AS mode, CASE name WHEN 'HAL_UART_Receive_DMA' THEN 'dma_rx' ELSE 'dma_tx' END AS context_id FROM arguments WHERE name LIKE 'HAL_%' AND arg = 1 UNION ALL SELECT DISTINCT site, NULL, NULL, NULL FROM arguments WHERE name = 'my_dma_start'", "arguments")
query("macro_owner", lambda f: access.macro_owner(f.supplier.select(F.col("s_suppkey").alias("site"), F.concat(F.lit("n"), F.col("s_suppkey") % 25, F.lit("/f"), F.col("s_suppkey") % 4, F.lit(".c")).alias("file"), (F.col("s_suppkey") * 37 % 3000).alias("pos")), f.functions),
      "SELECT s_suppkey AS site, function_id FROM supplier JOIN functions ON file = 'n' || s_suppkey % 25 || '/f' || s_suppkey % 4 || '.c' AND s_suppkey * 37 % 3000 BETWEEN line AND end_line", "functions")
query("local_aliases", lambda f: access.local_aliases(f.calls.select(F.col("caller").alias("pointer"), F.when(F.col("line") % 5 == 0, F.col("callee_name")).alias("symbol_id"), F.when(F.col("line") % 5 == 1, F.col("callee")).alias("source"))),
      ", own AS (SELECT DISTINCT caller AS pointer, callee_name AS symbol_id FROM calls WHERE line % 5 = 0), cp AS (SELECT DISTINCT caller AS pointer, callee AS source FROM calls WHERE line % 5 = 1), w AS (SELECT pointer, symbol_id, 0 AS d FROM own UNION SELECT cp.pointer, w.symbol_id, w.d + 1 FROM cp JOIN w ON cp.source = w.pointer WHERE w.d < 3) SELECT DISTINCT pointer, symbol_id FROM w", "calls")

# Text
_SHAPES = "(VALUES (0, 3, 3, 'if', 'A'), (0, 5, 5, 'elif', 'B'), (0, 7, 7, 'else', ''), (0, 9, 9, 'endif', ''), (0, 10, 10, 'endif', ''), (1, 3, 3, 'if', 'A'), (1, 4, 4, 'ifdef', 'B'), (1, 6, 6, 'endif', ''), (1, 7, 7, 'endif', ''), (1, 8, 8, 'endif', ''), (2, 5, 5, 'endif', ''), (3, 3, 3, 'if', 'A'), (3, 5, 5, 'endif', '')) v(s, a, b, cmd, expr)"
_ARMS = "(VALUES (0, 1, 1, 1, 9, 'ifndef', NULL, true), (0, 3, 1, 3, 4, 'if', 1, false), (0, 3, 2, 5, 6, 'elif', 1, false), (0, 3, 3, 7, 8, 'else', 1, false), (1, 1, 1, 1, 7, 'ifndef', NULL, true), (1, 3, 1, 3, 6, 'if', 1, false), (1, 4, 1, 4, 5, 'ifdef', 3, false), (2, 1, 1, 1, 4, 'ifndef', NULL, true), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) v(s, \"open\", nth, start, stop, cmd, parent, guard)"
query("strip_comments", lambda f: f.sources.select("file", text.strip_comments(F.col("text")).alias("text")), "SELECT file, replace(replace(text, '/* #if X */', repeat(' ', 11)), '// #endif', repeat(' ', 9)) AS text FROM sources", "sources")
query("directives", lambda f: f.directives, f'SELECT file, 1 AS start, 1 AS "end", \'ifndef\' AS cmd, guard AS expr FROM sources UNION ALL SELECT file, 2, 2, \'define\', guard FROM sources UNION ALL SELECT file, a, b, cmd, expr FROM sources JOIN {_SHAPES} ON shape = s', "sources")
query("conditional_groups", lambda f: f.branches, f'SELECT file, "open", nth, start, stop, cmd, parent, v.guard FROM sources JOIN {_ARMS} ON shape = s', "sources")
_TAKEN = "(VALUES (0, 3, 1, '#if 1', '#elif 0 ', ''), (0, 3, 2, '#if 0', '#elif 1 ', ''), (0, 3, 3, '#if 0', '#elif 0 ', ''), (1, 3, 1, '#if 1', '', '#ifdef B'), (1, 4, 1, '#if 1', '', '#if 1   ')) v(s, \"open\", nth, x, y, z)"
query("branch_variants", lambda f: text.file_variants(f.sources), f'SELECT file, "open", nth, replace(replace(replace(text, \'#if A\', x), \'# elif B\', y), \'#ifdef B\', z) AS text FROM sources JOIN {_TAKEN} ON shape = s', "sources")
query("branch_owned", lambda f: text.branch_owned(text.lines(f.sources, F.col("text")).where("text like 'int%'").select("file", "line"), f.branches), "SELECT file, line, start, stop FROM sources JOIN (VALUES (0, 4, 3, 4), (0, 6, 5, 6), (0, 8, 7, 8), (1, 5, 4, 5), (2, 4, 1, 4)) v(s, line, start, stop) ON shape = s", "sources")
query("asm_references", lambda f: text.assembly_references(f.assembly, f.variables, f.functions),
      "SELECT 'ASSEMBLY_SYMBOL_REFERENCE' AS kind, symbol_id AS target, file, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS line FROM assembly JOIN variables ON name = 'v' || event_id % 3000 AND linkage = 'EXTERNAL' UNION ALL SELECT 'ASSEMBLY_FUNCTION_REFERENCE', function_id, assembly.file, CASE WHEN event_id % 50 = 0 THEN 3 ELSE 2 END FROM assembly JOIN functions ON name = 'f' || event_id % 2000 AND linkage = 'EXTERNAL' UNION ALL SELECT 'ASSEMBLY_SOURCE_REVIEW', NULL, file, NULL FROM assembly WHERE event_id % 50 = 0", "assembly", "variables", "functions")
query("transcript_text", lambda f: text.transcript_text(f.logs), "SELECT finding_id, 'a' || event_id || chr(10) || 'b' AS answer, event_id % 7 = 0 AS failed FROM logs", "logs")
query("answer_parse", lambda f: f.answers.select("finding_id", text.final_json(F.col("answer"), F.col("finding_id")).alias("json")), "SELECT finding_id, CASE o_orderkey % 4 WHEN 1 THEN '{\"a\":2}' WHEN 3 THEN NULL ELSE '{\"finding_id\":\"' || finding_id || '\"}' END AS json FROM answers", "answers")
# No given text has an end inside brackets, so references go between its sentences: nested, with a closer that closes nothing, one in five left open.
_PROSE = "translate(replace(text, '. ', CASE WHEN doc_id % 5 = 0 THEN '. [see {4. ]} ' ELSE '. [see (1.2; 3) or {4. ]}] ' END), '.;', '。；')"
# In SQL: pairs of brackets become other characters from the innermost on, with the ends inside; from an opener that is left, nothing ends.
_MARKS, _OPEN, _HIDDEN = "()[]{}（）；。\n", r"(\[{（", "".join(map(chr, range(0xE000, 0xE00B)))
_PAIRS = "|".join(f"[{e}{o}][^{_OPEN}{e}{c}]*[{e}{c}]" for o, c in text.BRACKETS.items() for e in ["\\" if o < "~" else ""])
_PAIRED = f"array_to_string(list_transform(regexp_extract_all(t, '{_PAIRS}|[^{_OPEN}]+|[{_OPEN}]'), lambda s: CASE WHEN length(s) > 1 AND s[1] IN ('(', '[', '{{', '（') THEN translate(s, '{_MARKS}', '{_HIDDEN}') ELSE s END), '')"
_ENDED = f"[^。；\n{_OPEN}]*[。；\n]|[^。；\n{_OPEN}]*[{_OPEN}](?s:.*)|[^。；\n{_OPEN}]+"
query("split_paragraphs", lambda f: f.documents.select("doc_id", F.posexplode(text.paragraphs(F.expr(_PROSE)))).select("doc_id", F.col("pos").alias("nth"), F.sha2("col", 256).alias("part")),
      f"WITH RECURSIVE paired(doc_id, t) AS (SELECT doc_id, {_PROSE} FROM documents UNION ALL SELECT doc_id, r FROM (SELECT doc_id, t, {_PAIRED} AS r FROM paired) WHERE r <> t) SELECT doc_id, CAST(i - 1 AS INTEGER) AS nth, sha256(p[i]) AS part FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '{_ENDED}'), lambda s: trim(translate(s, '{_HIDDEN}', '{_MARKS}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '') AS p FROM paired WHERE t = {_PAIRED}))")
query("numbered_steps", lambda f: f.answers.select("finding_id", F.posexplode(text.numbered_steps(F.concat(F.lit("Before (a) 2.1) x："), F.lit("(1)"), "answer", F.lit("（2） b (3) ③④ "), "finding_id", F.when(F.col("o_orderkey") % 3 == 0, " [4) not] 5) end").otherwise("")))).alias("nth", "step")).groupBy("finding_id").agg(F.count("*").alias("n_steps"), F.count("step.label").alias("n_labels")),
      "SELECT finding_id, CAST(6 + (o_orderkey % 3 = 0)::INTEGER AS BIGINT) AS n_steps, CAST(5 + (o_orderkey % 3 = 0)::INTEGER AS BIGINT) AS n_labels FROM answers", "answers")
_LINES = "src AS (SELECT 'd' || doc_id AS file, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents), ev AS (SELECT doc_id AS ref, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE 'd' || doc_id END AS file, doc_id % 4 AS line, substr(text, 1 + doc_id % 7, 5) AS quote FROM documents WHERE text IS NOT NULL)"
query("evidence_check", lambda f: text.evidence_check(f.evidence, f.source_lines), f"WITH {_LINES}, l AS (SELECT file, max(line) AS last FROM src GROUP BY file) SELECT ref, ev.file, ev.line::INTEGER AS line, CASE WHEN last IS NULL THEN 'NO_FILE' WHEN ev.line < 1 OR ev.line > last THEN 'NO_LINE' WHEN trim(quote, ' ') = '' THEN 'NO_QUOTE' WHEN contains(text, trim(quote, ' ')) THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM ev LEFT JOIN l ON l.file = ev.file LEFT JOIN src ON src.file = ev.file AND src.line = ev.line")
query("evidence_window", lambda f: text.evidence_window(f.evidence, f.source_lines), f"WITH {_LINES} SELECT ref, src.file, src.line::INTEGER AS line, src.text FROM ev JOIN src ON src.file = ev.file AND src.line BETWEEN ev.line - 3 AND ev.line + 3")

# Sets, files and state
query("file_manifest", lambda f: f.documents.select("doc_id", F.sha2("text", 256).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents")
query("canonical_digest", lambda f: sets.canonical_digest(f.documents.select("doc_id", "text", F.struct(F.col("source").alias("z"), F.array("lang", F.lit(None)).alias("a"), F.create_map(F.lit("n"), F.col("n_chars")).alias("m")).alias("meta")), ["doc_id", "text", "meta"]).select("doc_id", "digest"),
      """WITH RECURSIVE raw AS (SELECT doc_id, text, source, lang, n_chars FROM documents), esc AS (SELECT *, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') AS t FROM raw)
  SELECT doc_id, sha256('{"doc_id": ' || doc_id || ', "meta": {"a": [' || coalesce('"' || lang || '"', 'null') || ', null], "m": {"n": ' || coalesce(n_chars::VARCHAR, 'null') || '}, "z": ' || coalesce('"' || source || '"', 'null') || '}, "text": ' || coalesce('"' || t || '"', 'null') || '}') AS digest FROM esc""")
query("compile_arguments", lambda f: command_line.normalised(f.compile_entries.withColumn("arguments", F.lit(None).cast("array<string>")), f.response_files, ["-Wall"], ["-g"]).select("tu", "source", F.array_join("arguments", "|").alias("arguments"), F.array_join("removed_arguments", "|").alias("removed_arguments"), F.array_join("response_files", "|").alias("response_files"), "target", "problem"),
      """, x AS (SELECT *, tu % 5 AS s FROM compile_entries) SELECT tu, '/w/src/f' || tu || '.c' AS source, CASE WHEN tu % 11 IN (7, 8, 9) THEN NULL ELSE CASE WHEN s = 0 THEN '-DN=a b' WHEN s = 1 THEN '-DQ="q"|x\\y' ELSE '-I' || tu END || '|-DR=' || tu % 7 || '|two words|-DLAST|-DEND' || CASE WHEN s = 2 THEN '|--target=arm-none-eabi' ELSE '' END || '|-Wall' END AS arguments,
  CASE WHEN tu % 11 IN (7, 8, 9) THEN NULL ELSE '-c|-o|x.o|-MFdep|-g|../src/f' || tu || '.c' END AS removed_arguments, CASE WHEN tu % 11 = 7 THEN '' WHEN tu % 11 = 8 THEN '/w/build/loop.rsp' WHEN tu % 11 = 9 THEN '/w/build/none.rsp' ELSE '/w/build/nested.rsp|/w/build/r' || tu % 7 || '.rsp' END AS response_files,
  CASE WHEN s = 2 AND tu % 11 NOT IN (7, 8, 9) THEN 'arm-none-eabi' END AS target, CASE tu % 11 WHEN 7 THEN 'QUOTE' WHEN 8 THEN 'CYCLE' WHEN 9 THEN 'MISSING' END AS problem FROM x""", "compile_entries")
query("config_violations", lambda f: config_check.config_violations(f.configs), """SELECT c_custkey AS config_id, path, problem FROM customer JOIN (VALUES (1, '$.contexts[1]', 'ID_TWICE'), (1, '$.preemption[0]', 'UNKNOWN_CONTEXT'), (1, '$.entry_registrations[0]', 'CONTEXT_KIND_CONFLICT'), (2, '$.contexts[1]', 'UNKNOWN_KIND'), (3, '$.preemption[0]', 'UNKNOWN_CONTEXT'),
  (4, '$.entry_registrations[0]', 'CALLBACK_ARG'), (5, '$.entry_registrations[0]', 'CONTEXT_KIND_CONFLICT'), (6, '$.review.workers', 'NOT_1_TO_8'), (7, '$.project.native_word_bits', 'NOT_A_MULTIPLE_OF_8'), (8, '$.analysis.include_dirs', 'NOT_A_PATH'), (9, '$', 'NOT_A_VERSION_1_MAPPING')) v(k, path, problem) ON c_custkey % 10 = k""")
query("review_history", lambda f: runs.review_history(f.review_runs).select("run_id", "finding_id", "pass", "seq", "place", "last_of_pass"),
      'SELECT run_id, finding_id, "pass", seq, row_number() OVER (PARTITION BY finding_id ORDER BY run_id, "pass", seq)::INTEGER AS place, row_number() OVER (PARTITION BY finding_id, "pass" ORDER BY run_id DESC, seq DESC) = 1 AS last_of_pass FROM (SELECT *, \'r\' || seq % 3 AS run_id FROM review_events)', "review_events")
query("review_states", lambda f: runs.review_states(f.findings, f.review_runs, True),
      """, e AS (SELECT *, 'r' || seq % 3 AS run_id, row_number() OVER (PARTITION BY finding_id ORDER BY "pass" DESC, 'r' || seq % 3 DESC, seq DESC) = 1 AS newest FROM review_events), l AS (SELECT finding_id, state, status, "pass" = 0 AND state IN ('DONE', 'FAILED') AS waits FROM e WHERE newest), n AS (SELECT finding_id, count(*) FILTER ("pass" = 0) AS n_first, count(*) FILTER ("pass" = 1) AS n_second FROM e GROUP BY finding_id)
  SELECT f.finding_id, CASE WHEN l.finding_id IS NULL THEN 'PENDING' WHEN waits THEN 'AUDIT_PENDING' ELSE l.state END AS state, CASE WHEN l.finding_id IS NULL OR waits THEN 'NEED_MORE_CONTEXT' ELSE l.status END AS status, coalesce(n_first, 0) AS n_first, coalesce(n_second, 0) AS n_second FROM (SELECT DISTINCT finding_id FROM findings) f LEFT JOIN l USING (finding_id) LEFT JOIN n USING (finding_id)""", "review_events", "findings")
query("first_entries", lambda f: joined(presentation.first_entries(f.accesses.select("symbol_id", "function_id").distinct().join(f.bindings, "function_id").groupBy("symbol_id", "context_id").agg((F.min("call_depth") + 1).alias("distance")).join(f.contexts, "context_id")), "entries"),
      """, e AS (SELECT symbol_id, context_id, min(depth) + 1 AS distance FROM accesses JOIN depths USING (function_id) GROUP BY symbol_id, context_id), n AS (SELECT e.*, row_number() OVER (PARTITION BY symbol_id ORDER BY kind <> 'MAIN', distance, context_id) AS nth FROM e JOIN contexts USING (context_id))
  SELECT symbol_id, string_agg(context_id, ',' ORDER BY nth) FILTER (nth <= 2) AS entries, greatest(count(*) - 2, 0) AS n_more FROM n GROUP BY symbol_id""", "accesses", "depths", "contexts")
query("cells", lambda f: f.documents.select("doc_id", F.sha2(presentation.cell(F.replace("text", F.lit("."), F.lit("|"))), 256).alias("cell"), presentation.place(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")), F.col("doc_id") % 7).alias("place")),
      "SELECT doc_id, sha256(coalesce(replace(replace(replace(text, '.', '|'), '|', chr(92) || '|'), chr(10), ' '), '—')) AS cell, CASE WHEN doc_id % 5 = 0 OR source IS NULL THEN '未知' ELSE source END || ':' || CASE WHEN doc_id % 7 = 0 THEN '?' ELSE (doc_id % 7)::VARCHAR END AS place FROM documents")
query("configured_sets", lambda f: rules.configured_sets(f.readers_writers, [["C0", "C2"], ["C1", "C3", "C4"], ["C9"], ["C2"]]), "SELECT symbol_id, v.place::INTEGER AS place FROM rw JOIN (VALUES (0, ['C0', 'C2']), (1, ['C1', 'C3', 'C4']), (2, ['C9']), (3, ['C2'])) v(place, c) ON list_has_all(contexts, c)", "rw")
query("findings_in_scope", lambda f: joined(scope.closed(rules.findings(f.profile.join(scope.select_variables(f.variables, SCOPE).select("symbol_id"), "symbol_id", "left_semi")), f.variables, SCOPE).select("finding_id", "symbol_id", "rules"), "rules"), ", {scope} SELECT finding_id, symbol_id, rules FROM found WHERE symbol_id IN (SELECT symbol_id FROM in_scope)", "found", "variables")
query("independent_gaps", lambda f: review.independent_gaps(f.findings), "SELECT count(*) FILTER (symbol_id IS NULL) AS independent_gaps FROM findings", "findings")
query("evidence_receipts", lambda f: text.evidence_receipts(f.evidence, f.source_lines, f.documents.select(F.concat(F.lit("d"), "doc_id").alias("file"), F.sha2("text", 256).alias("sha256"))).select("ref", "file", "line", "sha256"),
      f"WITH {_LINES} SELECT ref, src.file, src.line::INTEGER AS line, sha256(d.text) AS sha256 FROM ev JOIN src ON src.file = ev.file AND src.line BETWEEN ev.line - 3 AND ev.line + 3 JOIN documents d ON src.file = 'd' || d.doc_id")
query("row_digest", lambda f: f.resources.select("resource", sets.row_digest(["resource", "owner_context"], 16).alias("digest")), "SELECT resource, substr(sha256('owner_context=''' || owner_context || ''',resource=''' || resource || ''''), 1, 16) AS digest FROM resources", "resources")
query("dedup_rows", lambda f: f.syntax.dropDuplicates().groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM syntax) GROUP BY kind", "syntax")
query("union_parts", lambda f: sets.union_parts([f.resources, f.protection, f.contexts]).groupBy("owner_context", "kind").agg(F.count("*").alias("n")), "SELECT owner_context, NULL::VARCHAR AS kind, count(*) AS n FROM resources GROUP BY owner_context UNION ALL SELECT NULL, NULL, count(*) FROM protection UNION ALL SELECT NULL, kind, 1 FROM contexts", "resources", "protection", "contexts")
query("baseline_diff", lambda f: sets.baseline_diff(f.findings, f.review_events), "SELECT finding_id, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'no_longer_observed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT finding_id, 1 AS a FROM findings) FULL JOIN (SELECT DISTINCT finding_id, 1 AS b FROM review_events) USING (finding_id)", "findings", "review_events")
query("manifest_diff", lambda f: sets.manifest_diff(f.documents.where("doc_id % 13 <> 1").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256")), f.documents.where("doc_id % 13 <> 2").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 13 == 3, "old").otherwise(F.sha2("text", 256)).alias("sha256")), ["3"]),
      "SELECT doc_id::VARCHAR AS path, CASE doc_id % 13 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 13 IN (1, 2, 3) AND doc_id <> 3")
query("unlisted_sources", lambda f: sets.unlisted_sources(sets.source_files(f.files), f.units), ", {files} SELECT file FROM src_files WHERE file NOT IN (SELECT file FROM units)", "files", "units")
query("src_files", lambda f: sets.source_files(f.files), ", {files} SELECT file FROM src_files", "files")
query("units_by_file", lambda f: sets.units_by_file(f.unit_rows).distinct(), "SELECT tu, file FROM units UNION SELECT tu, header FROM units", "units")
query("file_coverage", lambda f: sets.file_coverage(f.files, f.units, f.units.select(F.col("header").alias("file"), "parse_status"), f.locations.select(F.concat(F.lit("u"), F.length("location"), F.lit(".c")).alias("file"), F.col("location").alias("symbol_id")), f.files.where("file like '%9.c'")),
      """, st AS (SELECT file, bool_and(parse_status = 'PARSED') AS ok, bool_and(parse_status = 'FAILED') AS bad FROM units GROUP BY file), fb AS (SELECT header AS file, bool_and(parse_status = 'PARSED') AS ok, bool_and(parse_status = 'FAILED') AS bad FROM units GROUP BY header)
  SELECT f.file, CASE WHEN f.file LIKE '%9.c' THEN 'PARTIAL' WHEN coalesce(st.ok, fb.ok) IS NULL THEN 'NOT_COMPILED' WHEN coalesce(st.ok, fb.ok) THEN 'PARSED' WHEN coalesce(st.bad, fb.bad) THEN 'FAILED' ELSE 'PARTIAL' END AS parse_status, CASE WHEN st.ok IS NOT NULL THEN 'compile_database' ELSE 'supplemental' END AS coverage_source,
  (SELECT count(*) FROM locations WHERE 'u' || length(location) || '.c' = f.file) AS variable_count FROM files f LEFT JOIN st USING (file) LEFT JOIN fb USING (file)""", "files", "units", "locations")
query("merge_supplemental", lambda f: sets.merge_supplemental(f.variables.select("symbol_id", "name", "kind", F.col("declaration_file").alias("file"), F.col("definition_line").alias("line")), f.supplemental).groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("symbol_id").alias("n_ids")),
      """, e AS (SELECT s.*, row_number() OVER (PARTITION BY s.file, s.line, s.name, s.kind ORDER BY ord) > 1 OR (s.file, s.line, s.name, s.kind) IN (SELECT (declaration_file, definition_line, name, kind) FROM variables) AS gone FROM supplemental s), k AS (SELECT *, symbol_id IN (SELECT symbol_id FROM variables) OR row_number() OVER (PARTITION BY symbol_id ORDER BY ord) > 1 AS hits FROM e WHERE NOT gone)
  SELECT action, count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT CASE WHEN NOT hits THEN 'new' WHEN kind = 'GLOBAL' THEN 'attached' ELSE 'renamed' END AS action, CASE WHEN hits AND kind <> 'GLOBAL' THEN file || '|' || line || '|' || name || '|' || kind ELSE symbol_id END AS id FROM k UNION ALL SELECT 'dropped', symbol_id FROM e WHERE gone) GROUP BY action""", "variables", "supplemental")
query("local_ordinal", lambda f: sets.local_ordinals(f.declared.distinct()), "SELECT function_id, name, pos, (row_number() OVER (PARTITION BY function_id, name ORDER BY pos) - 1)::INTEGER AS ordinal FROM (SELECT DISTINCT * FROM declared)", "declared")
query("src_compile_db", lambda f: sets.compile_entries(f.supplier.select(F.col("s_suppkey").alias("tu"), F.to_json(F.struct(F.concat(F.lit("s"), "s_suppkey", F.lit(".c")).alias("file"), F.lit("/w").alias("directory"), F.array(F.lit("-c"), F.lit("-DA=1")).alias("arguments"))).alias("entry"))).select("tu", "file", "directory", F.array_join("arguments", " ").alias("arguments")),
      "SELECT s_suppkey AS tu, 's' || s_suppkey || '.c' AS file, '/w' AS directory, '-c -DA=1' AS arguments FROM supplier")
query("src_facts_json", lambda f: f.resources.select(F.to_json(F.struct("resource", "owner_context", "business_critical")).alias("row")).select(F.from_json("row", "resource string, owner_context string, business_critical boolean", {"mode": "FAILFAST"}).alias("r")).select("r.*"), "SELECT * FROM resources", "resources")
query("compile_defines", lambda f: sets.effective_defines(f.supplier.select(F.col("s_suppkey").alias("tu"), F.array(F.lit("-c"), F.lit("-DA=1"), F.lit("-D"), F.concat(F.lit("B="), F.col("s_suppkey")), F.when(F.col("s_suppkey") % 3 == 0, "-UA").otherwise("-O2"), F.when(F.col("s_suppkey") % 2 == 0, "-DB").otherwise("-DC=x=y")).alias("arguments"))),
      "SELECT tu, macro, value FROM (SELECT s_suppkey AS tu, 'A' AS macro, '1' AS value FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'B', CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE s_suppkey::VARCHAR END FROM supplier UNION ALL SELECT s_suppkey, 'C', 'x=y' FROM supplier WHERE s_suppkey % 2 = 1)")
query("missing_defines", lambda f: sets.missing_defines(f.resources.where("business_critical").select(F.col("resource").alias("tu"), F.lit("A").alias("macro"), F.col("owner_context").alias("value")), f.resources.select(F.col("resource").alias("tu")), ["A=C2", "A", "B"]),
      "SELECT resource AS tu, e AS expected FROM resources, (VALUES ('A=C2'), ('A'), ('B')) v(e) WHERE e = 'B' OR NOT business_critical OR e = 'A=C2' AND owner_context <> 'C2'", "resources")
query("scan_valid", lambda f: sets.scan_valid(f.resources.select(F.col("resource").alias("run_id"), F.col("owner_context").alias("config"), F.lit("e1").alias("engine")), f.resources.where("resource <> 'P3'").select(F.col("resource").alias("run_id"), F.when(F.col("business_critical"), "C1").otherwise(F.col("owner_context")).alias("config"), F.lit("e1").alias("engine"))),
      "SELECT resource AS run_id, differs = '' AS valid, differs FROM (SELECT resource, CASE WHEN resource = 'P3' THEN 'config,engine' WHEN business_critical AND owner_context <> 'C1' THEN 'config' ELSE '' END AS differs FROM resources)", "resources")

# Review
query("queue_state", lambda f: review.latest(f.review_events), ', x AS (SELECT finding_id, arg_max({{\'s\': state, \'t\': status, \'p\': "pass"}}, "pass" * 1000000000 + seq) AS v, count(*) - 1 AS n FROM review_events GROUP BY finding_id) SELECT finding_id, v.s AS state, v.t AS status, v.p AS "pass", n AS n_previous FROM x'.replace("{{", "{").replace("}}", "}"), "review_events")
query("audit_latest", lambda f: review.latest(f.review_events.where("pass = 1")), ', x AS (SELECT finding_id, arg_max({\'s\': state, \'t\': status}, seq) AS v, count(*) - 1 AS n FROM review_events WHERE "pass" = 1 GROUP BY finding_id) SELECT finding_id, v.s AS state, v.t AS status, 1::BIGINT AS "pass", n AS n_previous FROM x', "review_events")
_REC = """rec AS (SELECT f.*, string_split(rule_list, ',') AS rules, coalesce(r.state, 'PENDING') AS state, coalesce(r.status, 'NEED_MORE_CONTEXT') AS status FROM findings f LEFT JOIN (SELECT finding_id, state, status FROM review_events QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY "pass" DESC, seq DESC) = 1) r USING (finding_id)),
  cat AS (SELECT *, CASE WHEN state <> 'DONE' THEN 'unresolved' WHEN status = 'CONFIRMED' THEN 'confirmed' WHEN status = 'LIKELY' THEN 'likely' WHEN status IN ('REVIEWED_SAFE', 'FALSE_POSITIVE') THEN 'safe' ELSE 'unresolved' END AS c, len(list_filter(rules, lambda x: x IN ('GS-MULTI-CONTEXT', 'GS-MULTI-WRITER', 'GS-STALE-SNAPSHOT', 'DMA_SHARED_REVIEW'))) AS n_signals FROM rec),
  dec AS (SELECT *, CASE WHEN c = 'unresolved' AND n_signals > 0 THEN 'likely' ELSE c END AS decision FROM cat)"""
_NEED = ("findings", "review_events")
query("review_records", lambda f: f.records.select("finding_id", "state", "status"), f", {_REC} SELECT finding_id, state, status FROM rec", *_NEED)
query("decision", lambda f: f.records.select("finding_id", review.category().alias("category"), review.decision().alias("decision")), f", {_REC} SELECT finding_id, c AS category, decision FROM dec", *_NEED)
_VD = """vd AS (SELECT v.symbol_id, CASE WHEN coverage_source <> 'compile_database' THEN CASE WHEN settled THEN g ELSE 'supplemental' END WHEN parse_status = 'FAILED' THEN 'unresolved' WHEN g IS NOT NULL THEN g WHEN no % 6 = 0 THEN 'screened_safe' ELSE 'inventory' END AS decision FROM variables v LEFT JOIN (SELECT symbol_id, arg_min(decision, CASE decision WHEN 'confirmed' THEN 1 WHEN 'likely' THEN 2 WHEN 'unresolved' THEN 3 ELSE 4 END) AS g, bool_and(decision IN ('confirmed', 'safe')) AS settled FROM dec WHERE symbol_id IS NOT NULL GROUP BY symbol_id) d USING (symbol_id))"""
query("variable_decisions", lambda f: review.variable_decisions(f.states, f.records), f", {_REC}, {_VD} SELECT symbol_id, decision FROM vd", *_NEED, "variables")
query("risk_summary", lambda f: review.risk_summary(review.variable_decisions(f.states, f.records)), f", {_REC}, {_VD} SELECT d AS decision, count(symbol_id) AS n_variables FROM (VALUES ('confirmed'), ('likely'), ('unresolved'), ('safe'), ('screened_safe'), ('inventory'), ('supplemental')) k(d) LEFT JOIN vd ON decision = d GROUP BY d", *_NEED, "variables")
query("final_conclusion", lambda f: review.final_conclusion(f.records, False), f", {_REC}, n AS (SELECT count(*) FILTER (symbol_id IS NOT NULL AND c = 'confirmed') AS k, count(*) FILTER (c IN ('unresolved', 'likely')) AS o, count(*) FILTER (symbol_id IS NULL AND c = 'confirmed') AS g, count(*) AS t, count(*) FILTER (state = 'DONE') AS r FROM cat) SELECT CASE WHEN k > 0 THEN 'HAS_ISSUES' ELSE 'INCONCLUSIVE' END AS verdict, k AS confirmed, o + CASE WHEN k = 0 THEN g ELSE 0 END AS unresolved, t AS total, r AS reviewed FROM n", *_NEED)
query("review_summary", lambda f: review.review_summary(f.records), f", {_REC}, q AS (SELECT symbol_id, bool_and(c IN ('confirmed', 'safe')) AS s FROM cat WHERE symbol_id IS NOT NULL GROUP BY symbol_id) SELECT count(*) AS total, count(*) FILTER (c = 'confirmed') AS confirmed, count(*) FILTER (c = 'likely') AS likely, count(*) FILTER (c = 'unresolved') AS unresolved, count(*) FILTER (c = 'safe') AS safe, (SELECT count(*) FROM q) AS queued, (SELECT count(*) FROM q WHERE s) AS terminal FROM cat", *_NEED)
query("rule_order", lambda f: f.findings.select("finding_id", F.array_join(review.ordered_rules(F.split("rule_list", ",")), ",").alias("rules")),
      f"SELECT finding_id, array_to_string(list_filter({review.RULE_ORDER}, lambda c: list_contains(r, c)) || list_filter(r, lambda c: NOT list_contains({review.RULE_ORDER}, c)), ',') AS rules FROM (SELECT finding_id, string_split(rule_list, ',') AS r FROM findings)", "findings")
query("findings_sorted", lambda f: review.sorted_findings(f.findings).select("finding_id", "risk_level"), "SELECT finding_id, risk_level FROM findings", "findings")
query("findings_display_order", lambda f: review.display_order(f.records), f", {_REC} SELECT finding_id, decision, risk_level, n_signals::INTEGER AS n_signals FROM dec", *_NEED)
query("queue_limit", lambda f: review.queue_limit(f.findings, F.substring("finding_id", -1, 1) == "3", 73), "SELECT finding_id FROM findings WHERE finding_id NOT LIKE '%3' ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, finding_id LIMIT 73", "findings")
query("access_previews", lambda f: review.access_previews(f.accesses.join(f.bindings.groupBy("function_id").agg(F.bool_or(F.col("context_id") == "C2").alias("main"), F.min(F.size("path")).alias("chain")), "function_id", "left").withColumn("main", F.coalesce("main", F.lit(False)))),
      """, b AS (SELECT function_id, bool_or(context_id = 'C2') AS main, min(depth) + 1 AS chain FROM depths GROUP BY function_id), a AS (SELECT symbol_id, function_id, access_id, row_number() OVER (PARTITION BY symbol_id ORDER BY coalesce(main, false) DESC, CASE access_kind WHEN 'RMW' THEN 1 WHEN 'WRITE' THEN 2 ELSE 3 END, coalesce(chain, 999), access_id) AS k FROM accesses LEFT JOIN b USING (function_id) WHERE access_kind <> 'ADDRESS_TAKEN')
  SELECT symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY k)::INTEGER AS place, access_id FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol_id, function_id ORDER BY k) = 1) QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY k) <= 2""", "accesses", "depths")
query("line_budget", lambda f: review.line_budget(f.line_groups),
      """, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY function_id) AS k FROM line_groups), w AS (SELECT group_id, function_id, k, n_lines <= 1600 AS fits, 1600 - CASE WHEN n_lines <= 1600 THEN n_lines ELSE 0 END AS rest FROM o WHERE k = 1 UNION ALL SELECT o.group_id, o.function_id, o.k, o.n_lines <= w.rest, w.rest - CASE WHEN o.n_lines <= w.rest THEN o.n_lines ELSE 0 END FROM w JOIN o ON o.group_id = w.group_id AND o.k = w.k + 1) SELECT group_id, function_id FROM w WHERE fits""", "line_groups")
query("source_windows", lambda f: review.source_windows(f.accesses.select(F.col("symbol_id").alias("group_id"), "file", "line")), "SELECT DISTINCT symbol_id AS group_id, file, unnest(generate_series(greatest(line - 5, 1), line + 3)) AS line FROM accesses", "accesses")
query("source_manifest", lambda f: review.source_manifest(f.functions.select(F.lit("g").alias("group_id"), "function_id", "file", F.col("line").alias("start_line"), (F.col("line") + F.col("no") % 5).alias("end_line")), f.functions.select(F.lit("g").alias("group_id"), "file", F.explode(F.sequence(F.col("line") + F.col("no") % 2, F.col("line") + 4)).alias("line"))),
      ", s AS (SELECT DISTINCT file, unnest(generate_series(line + no % 2, line + 4)) AS l FROM functions) SELECT 'g' AS group_id, function_id, (SELECT count(*) FROM s WHERE s.file = f.file AND l BETWEEN f.line AND f.line + no % 5) = no % 5 + 1 AS complete FROM functions f", "functions")
query("review_requirements", lambda f: review.requirements(f.accesses.select(F.col("symbol_id").alias("finding_id"), "access_id"), f.findings.where("symbol_id is not null").select(F.col("symbol_id").alias("finding_id"), F.explode(F.split("rule_list", ",")).alias("rule")), f.open_points.where("symbol_id is not null").select(F.col("symbol_id").alias("finding_id"), F.col("kind").alias("blocker")), f.accesses.select(F.col("symbol_id").alias("finding_id"), "function_id")),
      "SELECT symbol_id AS finding_id, 'access:' || access_id AS id FROM accesses UNION SELECT symbol_id, 'rule:' || unnest(string_split(rule_list, ',')) FROM findings WHERE symbol_id IS NOT NULL UNION SELECT symbol_id, 'blocker:' || kind FROM open_points WHERE symbol_id IS NOT NULL UNION SELECT symbol_id, 'function:' || function_id FROM accesses", "accesses", "findings", "open_points")
query("investigation_check", lambda f: review.investigation_check(f.investigations.select("finding_id", "id", "assessment", F.when(F.col("cited") == 7, F.array().cast("array<int>")).otherwise(F.array("cited")).alias("refs")), f.investigated, f.findings.select("finding_id", F.lit("CONFIRMED").alias("status"), F.lit(5).alias("n_evidence"))),
      """, i AS (SELECT finding_id, id, assessment, cited FROM investigations) SELECT finding_id, id, 'MISSING' AS problem FROM investigated WHERE (finding_id, id) NOT IN (SELECT (finding_id, id) FROM i) UNION ALL SELECT finding_id, id, 'NOT_REQUIRED' FROM i WHERE (finding_id, id) NOT IN (SELECT (finding_id, id) FROM investigated) UNION ALL SELECT finding_id, id, 'REPEATED' FROM i GROUP BY finding_id, id HAVING count(*) > 1
  UNION ALL SELECT finding_id, id, CASE WHEN trim(assessment) = '' THEN 'NO_ASSESSMENT' WHEN cited = 7 THEN 'NO_EVIDENCE' ELSE 'BAD_REF' END FROM i WHERE trim(assessment) = '' OR cited IN (6, 7)""", "investigations", "investigated")
query("receipt_check", lambda f: review.receipt_check(f.logs.select("finding_id", F.when(F.col("event_id") % 13 == 0, "x").otherwise(F.sha2("log", 256)).alias("log_sha256"), F.lit("DONE").alias("status")), f.logs.where("event_id % 17 <> 0").select("finding_id", "log", F.when(F.col("event_id") % 19 == 0, "OPEN").otherwise("DONE").alias("status"))),
      "SELECT finding_id, CASE WHEN event_id % 17 = 0 THEN 'NO_LOG' WHEN event_id % 13 = 0 THEN 'LOG_CHANGED' WHEN event_id % 19 = 0 THEN 'STATUS_CHANGED' ELSE 'OK' END AS verdict FROM logs", "logs")
query("cache_reuse", lambda f: review.cache_reuse(f.findings.select("finding_id", F.lit("k1").alias("cache_key")), f.review_events.groupBy("finding_id").agg(F.max_by("cache_key", "seq").alias("cache_key"), F.max_by("state", "seq").alias("state"), F.max_by("status", "seq").alias("status"))),
      ", l AS (SELECT finding_id, arg_max(cache_key, seq) AS k, arg_max(state, seq) AS s, arg_max(status, seq) AS t FROM review_events GROUP BY finding_id) SELECT finding_id, coalesce(k = 'k1' AND s = 'DONE' AND t IN ('CONFIRMED', 'REVIEWED_SAFE', 'FALSE_POSITIVE'), false) AS reuse FROM findings LEFT JOIN l USING (finding_id)", "findings", "review_events")
query("stale_reviews", lambda f: review.staled(f.review_events, F.lit("fp1")).groupBy("state", "status").agg(F.count("*").alias("n")), "SELECT CASE WHEN state = 'DONE' AND scan_fingerprint <> 'fp1' THEN 'STALE' ELSE state END AS state, CASE WHEN state = 'DONE' AND scan_fingerprint <> 'fp1' THEN 'NEED_MORE_CONTEXT' ELSE status END AS status, count(*) AS n FROM review_events GROUP BY ALL", "review_events")
query("exit_code", lambda f: review.exit_code(f.resources.select(F.col("resource").alias("run_id"), (F.col("resource") == "P0").alias("interrupted"), (F.col("resource") == "P3").alias("failed"), F.col("business_critical").alias("complete"), F.when(F.col("owner_context") == "C2", 1).otherwise(0).alias("pending"), F.when(F.col("owner_context") == "C1", 0).otherwise(1).alias("findings"))),
      "SELECT resource AS run_id, CASE WHEN resource = 'P0' THEN 130 WHEN resource = 'P3' THEN 3 WHEN NOT business_critical OR owner_context = 'C2' THEN 2 WHEN owner_context <> 'C1' THEN 1 ELSE 0 END AS code FROM resources", "resources")
query("answer_violations", lambda f: review.answer_violations(f.answers.select("finding_id", text.final_json(F.col("answer"), F.col("finding_id")).alias("answer"), F.lit("VARIABLE").alias("review_type"))), "SELECT finding_id, CASE o_orderkey % 4 WHEN 1 THEN 'FINDING_ID' WHEN 3 THEN 'NOT_JSON' ELSE 'STATUS' END AS problem FROM answers", "answers")
query("review_packet", lambda f: review.packet(f.findings.where("symbol_id is not null").select(F.col("symbol_id").alias("finding_id")).distinct(), f.accesses.select(F.col("symbol_id").alias("finding_id"), "function_id").distinct(), f.functions, f.edges),
      ", r AS (SELECT DISTINCT symbol_id AS finding_id, function_id FROM accesses), o AS (SELECT finding_id, count(*) AS n_functions, sum(end_line - line + 1)::BIGINT AS n_lines FROM r JOIN functions USING (function_id) GROUP BY finding_id), e AS (SELECT finding_id, count(*) AS n_edges FROM (SELECT DISTINCT finding_id, caller, callee FROM r JOIN edges ON function_id IN (caller, callee)) GROUP BY finding_id) SELECT DISTINCT symbol_id AS finding_id, coalesce(n_functions, 0) AS n_functions, coalesce(n_lines, 0) AS n_lines, coalesce(n_edges, 0) AS n_edges FROM findings LEFT JOIN o ON o.finding_id = symbol_id LEFT JOIN e ON e.finding_id = symbol_id WHERE symbol_id IS NOT NULL", "accesses", "functions", "edges", "findings")

_OUT = scope.OUTSIDE
PARTS = {
    "{scope}": f"""ex AS (SELECT symbol_id, definition_file, declaration_file, coalesce(definition_file, declaration_file) AS path FROM variables), scoped AS (SELECT *, {{ex_path}} AS path_ex, {{ex_def}} AS def_ex, path_in AND {{ex_path}} IS NULL AS ok, def_in0 AND {{ex_def}} IS NULL AS def_in, CASE WHEN {{ex_path}} IS NOT NULL THEN {{ex_path}} WHEN NOT path_in THEN '{_OUT}' END AS reason FROM (SELECT *, {{in_path}} AS path_in, {{in_def}} AS def_in0 FROM ex)), in_scope AS (SELECT symbol_id FROM scoped WHERE reason IS NULL)""",
    "{core}": "ob AS (SELECT path AS variant, name, address, size, binding, coalesce(f, '') AS file FROM (SELECT *, last_value(CASE WHEN type = 4 THEN name END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord) AS f FROM elf) WHERE type = 1 AND defined AND size > 0), one AS (SELECT variant, symbol_id, min(address) AS address, min(size) AS size FROM (SELECT DISTINCT * FROM linked) l JOIN ob USING (variant, name) WHERE binding <> 0 OR ob.file = replace(definition_file, 'd/', '') GROUP BY variant, symbol_id HAVING count(*) = 1), ids AS (SELECT variant, symbol_id, CASE WHEN coalesce(ins, false) THEN 'shared:0x' || lower(to_hex(address)) || ':' || size ELSE variant || '::' || symbol_id END AS combined_id, coalesce(ins, false) AS shared FROM (SELECT l.variant, l.symbol_id, address, size, address >= 0 AND address + size <= 1600 OR address >= 3200 AND address + size <= 4000 AS ins FROM (SELECT DISTINCT * FROM linked) l LEFT JOIN one USING (variant, symbol_id)))",
    "{cfg}": "named AS (SELECT function_id, unnest([name, qualified_name, function_id, file || '::' || name]) AS n FROM functions), cfg AS (SELECT DISTINCT function_id, regexp_full_match(n, 'f.7') AS off FROM named WHERE regexp_full_match(n, 'T.*_IRQHandler|f10|n3::f20|nowhere|f1[0-9]5|missing|f.7'))",
    "{made}": """r1 AS (SELECT r.*, name FROM registrations r JOIN functions f USING (function_id) WHERE function_id NOT IN (SELECT function_id FROM cfg WHERE off) AND (configured OR function_id NOT IN (SELECT function_id FROM cfg WHERE NOT off))), r2 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY function_id, r1.file, pos, kind, given_id, CASE WHEN configured THEN may_repeat END ORDER BY ord) = 1),
  r3 AS (SELECT *, row_number() OVER (PARTITION BY function_id, file ORDER BY ord)::INTEGER AS ordinal, kind IN ('TIMER', 'DEFERRED') AS serial FROM r2), r4 AS (SELECT given_id, arg_min(kind, ord) AS first_kind FROM r3 WHERE NOT serial AND given_id IS NOT NULL GROUP BY given_id),
  made AS (SELECT ord, function_id, given_id, ordinal, may_repeat AND NOT serial AS may_repeat, CASE WHEN serial THEN 'TASK' ELSE kind END AS kind, CASE WHEN serial THEN 'auto:freertos:timer_daemon' WHEN given_id IS NULL THEN 'auto:' || lower(kind) || ':' || name || ':' || substr(sha256('[' || chr(34) || function_id || chr(34) || ', ' || chr(34) || file || chr(34) || ', ' || ordinal || ']'), 1, 12) WHEN kind = first_kind THEN given_id END AS context_id FROM r3 LEFT JOIN r4 USING (given_id))""",
    "{files}": "src_files AS (SELECT file FROM files WHERE regexp_matches(lower(file), '\\.(c|cc|cpp|cxx|h|hh|hpp|hxx|inc)$') AND file NOT LIKE '.git/%')",
}


def _fill(text: str) -> str:
    under = lambda p, d: f"({p} = '{d}' OR starts_with({p}, '{d}/'))"
    ex = lambda p: f"CASE WHEN {under(p, 'brand2/inc')} THEN 'exclude_dirs: brand2/inc' WHEN {under(p, 'brand12/p')} THEN 'exclude_dirs: brand12/p' WHEN {p} = 'brand1/p7.c' THEN 'exclude_files: brand1/p7.c' WHEN regexp_full_match({p}, 'brand1/p2.\\.c') THEN 'exclude: brand1/p2?.c' WHEN {under(p, 'brand12/p3.c')} THEN 'exclude: brand12/p3.c' END"
    inside = lambda p: "(" + " OR ".join(under(p, d) for d in SCOPE.include_dirs) + ")"
    for name, part in PARTS.items():
        text = text.replace(name, part)
    for name, part in {"{ex_path}": ex("path"), "{ex_def}": ex("definition_file"), "{in_path}": inside("path"), "{in_def}": inside("definition_file")}.items():
        text = text.replace(name, part)
    return text


SQL = {k: _fill(v) for k, v in SQL.items()}
