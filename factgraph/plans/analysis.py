"""One run from a project's facts and configuration to findings; each fixpoint's rows feed the next step."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators import access, contexts, graph, points_to, program, rules, sets
from factgraph.operators.graph import checkpointed
from factgraph.operators.scope import glob_regex

TEXT, WHOLE = T.StringType(), T.LongType()
UNKNOWN = ["kind", "symbol_id", "function_id", "target_function_id", "file", "line"]
#: What each table holds; a table that is left out is empty.
TABLES = {
    "functions": "function_id string, name string, qualified_name string, file string, line long, linkage string, parameter_count long, attributed boolean",
    "accesses": "access_id string, symbol_id string, function_id string, access_kind string, file string, line long, pos long, access_path string, via_alias boolean",
    "calls": "caller string, callee string, callee_name string, call_kind string, file string, line long",
    "unknowns": "kind string, symbol_id string, function_id string, target_function_id string, file string, line long",
    "registrations": "ord long, function_id string, file string, line long, pos long, kind string, given_id string, configured boolean, may_repeat boolean, api string, registered_by string",
    "constraints": "id long, lhs string, rhs string",
    "semantic_calls": "site long, function_id string, name string, target string, expression string, arguments array<string>, result string, file string, line long, pos long",
    "indirect_accesses": "item long, function_id string, location string, mode string, file string, line long, pos long",
    "snapshots": "symbol_id string, function_id string", "protection_events": "function_id string, event_kind string",
    "resources": "resource string, owner_context string, business_critical boolean", "protection": "resource string",
}


@dataclass
class Config:
    """What the project declares: contexts, call edges (caller, callee) and registration calls.

    registrations: api (shell pattern), callback_arg, kind, and optionally
    context_id and may_repeat. build_gaps are kinds of uncertainty of the build
    as a whole, such as PARSE_FAILED or SOURCE_NOT_IN_DATABASE.
    """

    contexts: list[dict] = field(default_factory=list)
    call_edges: list[tuple[str, str]] = field(default_factory=list)
    registrations: list[dict] = field(default_factory=list)
    auto_contexts: bool = True
    modelled: bool = True
    word_bytes: int = 4
    build_gaps: list[str] = field(default_factory=list)


def unknown(kind: str, df: DataFrame, **columns: Column | str) -> DataFrame:
    """Rows of one kind of uncertainty; columns that are not given are null."""
    of = lambda c: (F.col(columns[c]) if isinstance(columns[c], str) else columns[c]) if c in columns else F.lit(None)
    return df.select(F.lit(kind).alias("kind"), *(of(c).cast("long" if c == "line" else "string").alias(c) for c in UNKNOWN[1:])).distinct()


def one_of_each(accesses: DataFrame) -> DataFrame:
    """Accesses with one row of each access_id, the greatest. Only a hash of the ids is shuffled, and the rows of those that may be there twice."""
    rest = [c for c in accesses.columns if c != "access_id"]
    marked = accesses.withColumn("_h", F.xxhash64("access_id"))
    twice = checkpointed(marked.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"))
    several = marked.join(twice, "_h", "left_semi").groupBy("access_id").agg(F.max(F.struct(rest)).alias("row")).select("access_id", "row.*")
    return marked.join(twice, "_h", "left_anti").drop("_h").unionByName(several)


class Run:
    """The tables of one run, each made once, from what stands before it.

    Facts may bring contexts (context_id, kind, reentrant, discovery) and roots
    (context_id, function_id) of earlier runs, which join those of this one.
    """

    def __init__(self, spark, facts: dict[str, DataFrame], config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.earlier = {t: facts.get(t) for t in ("contexts", "roots")}
        self.given = {name: (facts[name] if name in facts else spark.createDataFrame([], schema)) for name, schema in TABLES.items()}
        # Their rows go into many steps and may cost more to derive than to read.
        self.given |= {t: checkpointed(self.given[t]) for t in ("semantic_calls", "constraints", "indirect_accesses") if t in facts}
        self.variables = facts["variables"]

    # ---- pointers

    @cached_property
    def solved(self) -> points_to.Solution:
        g = self.given
        return points_to.solution(program.run_instructions(g["constraints"], g["semantic_calls"], g["indirect_accesses"]))

    @cached_property
    def argument_values(self) -> DataFrame:
        """site, arg, value: what an argument may hold of a call whose name has an effect of its own (registration, library, hardware)."""
        names = {api for api, *_ in (*contexts.REGISTRATION_APIS, *access.API_SEMANTICS, *access.DMA_CONTRACTS)}
        modelled = reduce(Column.__or__, [F.rlike("name", F.lit(glob_regex(s["api"]))) for s in self.config.registrations], F.col("name").isin(*sorted(names)))
        at = self.given["semantic_calls"].where("site is not null").where(modelled).select("site", F.posexplode("arguments").alias("arg", "e"))
        held = self.solved.members("V", at.select(program.tree_key(F.col("e")).alias("key"), "site", "arg"))
        return checkpointed(held.select("site", "arg", "value").distinct())

    @cached_property
    def symbols(self) -> DataFrame:
        """location, symbol_id, access_path of all places that pointers or accesses name."""
        places = self.argument_values.select(F.col("value").alias("location")).union(self.item_places.select("location")).distinct()
        return checkpointed(points_to.location_symbols(places, self.variables))

    @cached_property
    def item_places(self) -> DataFrame:
        items, tree = self.given["indirect_accesses"].where("item is not null"), program.pointer(F.col("location"))
        through = self.solved.members("V", items.select(program.tree_key(tree).alias("key"), "item").where("key is not null")).where(~F.startswith("value", F.lit(points_to.FN)))
        named = items.where(tree.isNull()).select("item", program.tree_key(F.col("location")).alias("key")).join(self.solved.rows("L"), "key")
        return checkpointed(through.select("item", F.col("value").alias("location")).union(named.select("item", "value")).distinct())

    @cached_property
    def pointer_calls(self) -> DataFrame:
        """Calls through pointers, as calls."""
        sites = self.given["semantic_calls"].where("target is null").select(program.call_key(F.col("expression")).alias("key"), F.col("function_id").alias("caller"), "file", "line")
        targets = self.solved.members("T", sites).withColumnRenamed("value", "callee")
        names = self.given["functions"].select(F.col("function_id").alias("callee"), F.col("name").alias("callee_name"))
        found = targets.join(names, "callee", "left")
        return found.select("caller", "callee", F.coalesce("callee_name", "callee").alias("callee_name"), F.lit("INDIRECT_RESOLVED").alias("call_kind"), "file", "line")

    # ---- calls of libraries, hardware and registrations

    @cached_property
    def registration_sites(self) -> tuple[DataFrame, DataFrame]:
        sites = self.given["semantic_calls"].select("site", "name")
        return contexts.match_registrations(sites, self.config.registrations)

    @cached_property
    def callbacks(self) -> DataFrame:
        """Every use of a registration call by what it registers; function_id null where no target is known."""
        specs = [(f"spec{i}", i, s["callback_arg"], s["kind"], s.get("context_id"), s.get("may_repeat"), True) for i, s in enumerate(self.config.registrations)]
        specs += [(api, i, arg, kind, None, None, False) for i, (api, arg, kind) in enumerate(contexts.REGISTRATION_APIS)]
        rule = F.broadcast(self.spark.createDataFrame(specs, "spec string, place int, arg int, kind string, given_id string, may_repeat boolean, configured boolean"))
        used = self.registration_sites[0].join(rule, "spec").join(self.given["semantic_calls"].select("site", F.col("function_id").alias("registered_by"), "file", "line", "pos"), "site")
        targets = self.argument_values.where("value like 'fn:%'").select("site", "arg", F.expr("substring(value, 4)").alias("function_id"))
        return checkpointed(used.join(targets, ["site", "arg"], "left").withColumnRenamed("name", "api"))

    @cached_property
    def registrations(self) -> DataFrame:
        """Given registrations, then those of the calls in order of site, specification and target."""
        columns = ["function_id", "file", "line", "pos", "kind", "given_id", "configured", "may_repeat", "api", "registered_by"]
        order = lambda *c: F.struct(*(x.alias(f"o{i}") for i, x in enumerate(c))).alias("ord")
        given = self.given["registrations"].select(order(F.lit(0), F.col("ord"), F.lit(0), F.lit("")), *columns)
        repeats = F.coalesce("may_repeat", F.col("kind").isin(contexts.REPEATING))
        made = self.callbacks.where("function_id is not null").withColumn("may_repeat", repeats)
        return checkpointed(given.union(made.select(order(F.lit(1), F.col("site"), F.col("place"), F.col("function_id")), *columns)))

    @cached_property
    def transfers(self) -> DataFrame:
        """Hardware transfers by place: site, location, symbol_id (null: none), mode, context_id, hardware function."""
        dim = F.broadcast(self.spark.createDataFrame(access.DMA_CONTRACTS, "name string, arg int, mode string, direction string"))
        sites = self.given["semantic_calls"].join(dim, "name").where(F.size("arguments") > F.col("arg"))
        fid = F.concat(F.lit("hardware:"), sets.list_digest(20, ("function_id", TEXT), ("file", TEXT), ("pos", WHOLE)))
        held = sites.join(self.argument_values, ["site", "arg"], "left").join(self.symbols.withColumnRenamed("location", "value"), "value", "left")
        columns = [F.col("value").alias("location"), "symbol_id", "access_path", "mode", F.concat(F.lit("dma_"), "direction").alias("context_id"), fid.alias("hardware_id"), "function_id", "name", "file", "line", "pos"]
        return checkpointed(held.select("site", *columns))

    @cached_property
    def hardware(self) -> DataFrame:
        """context_id, kind, function_id and the rows of the functions that stand for hardware."""
        found = self.transfers.where("symbol_id is not null").select("context_id", F.lit("DMA").alias("kind"), F.col("hardware_id").alias("function_id"), "name", "file", "line")
        return checkpointed(found.distinct())

    @cached_property
    def functions(self) -> DataFrame:
        made = self.hardware.groupBy("function_id").agg(*(F.min(c).alias(c) for c in ("name", "file", "line")))
        made = made.select("function_id", "name", F.col("name").alias("qualified_name"), "file", F.col("line").cast("long").alias("line"), F.lit("HARDWARE").alias("linkage"), F.lit(None).cast("long").alias("parameter_count"), F.lit(False).alias("attributed"))
        return checkpointed(self.given["functions"].select(made.columns).union(made))

    @cached_property
    def accesses(self) -> DataFrame:
        """Given accesses, and those through pointers, library calls and hardware, each once."""
        calls, symbols = self.given["semantic_calls"], self.symbols
        dim = F.broadcast(self.spark.createDataFrame(access.API_SEMANTICS, "name string, arg int, mode string"))
        library = calls.join(dim, "name").join(self.argument_values.withColumnRenamed("value", "location"), ["site", "arg"]).join(symbols, "location")
        items = self.given["indirect_accesses"].drop("location").join(self.item_places, "item").join(symbols, "location")
        columns = ["symbol_id", "function_id", "mode", "file", "line", "pos", "access_path"]
        found = library.select(*columns, F.col("name").alias("via")).union(items.select(*columns, F.lit("").alias("via")))
        found = found.union(self.transfers.where("symbol_id is not null").withColumn("function_id", F.col("hardware_id")).select(*columns, F.col("name").alias("via")))
        ident = F.concat(F.lit("A-"), sets.list_digest(20, *((c, WHOLE if c in ("line", "pos") else TEXT) for c in (*columns, "via"))))
        made = found.select(ident.alias("access_id"), "symbol_id", "function_id", F.col("mode").alias("access_kind"), "file", "line", "pos", "access_path", F.lit(True).alias("via_alias")).dropDuplicates(["access_id"])
        return one_of_each(self.given["accesses"].select(made.columns)).unionByName(made)

    @cached_property
    def touched(self) -> DataFrame:
        """The accesses of each symbol in each function, summed up."""
        return checkpointed(rules.by_function(self.accesses))

    # ---- call graph and contexts

    @cached_property
    def configured_edges(self) -> DataFrame:
        if not self.config.call_edges:
            return self.spark.createDataFrame([], "edge int, caller string, callee string, kind string")
        return checkpointed(contexts.configured_edges(self.functions, self.config.call_edges))

    @cached_property
    def calls(self) -> DataFrame:
        """Given calls as they are, calls through pointers and configured ones; edges and external calls are made distinct from them."""
        set_up = self.configured_edges.where("kind = 'CONFIGURED'").select("caller", "callee").distinct()
        ends = self.functions.select("function_id", "name", "file", "line")
        made = set_up.join(ends.select(F.col("function_id").alias("caller"), "file", "line"), "caller").join(ends.select(F.col("function_id").alias("callee"), F.col("name").alias("callee_name")), "callee")
        made = made.select("caller", "callee", "callee_name", F.lit("CONFIGURED").alias("call_kind"), "file", "line")
        return checkpointed(self.given["calls"].select(made.columns).unionByName(self.pointer_calls.unionByName(made).distinct()))

    @cached_property
    def edges(self) -> DataFrame:
        return checkpointed(graph.call_graph_edges(self.calls, self.functions))

    @cached_property
    def _contexts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Contexts, roots (context_id, function_id) and what registrations have made."""
        specs, functions = self.config.contexts, self.functions
        hardware = self.hardware.select("context_id", "kind", "function_id")
        declared, roots, disabled = contexts.configured_contexts(functions, specs)
        roots, disabled = checkpointed(roots), checkpointed(disabled)
        if not self.config.auto_contexts:
            made = self.spark.createDataFrame([], "context_id string, kind string, may_repeat boolean, function_id string, given_id string, ord int")
            auto = self.spark.createDataFrame([], "context_id string, kind string, function_id string")
        else:
            auto = checkpointed(contexts.auto_contexts(functions, roots.select("function_id").union(disabled)))
            known = contexts.merged_contexts(hardware, declared, auto, self.spark.createDataFrame([], "context_id string, kind string, may_repeat boolean, given_id string"))
            made = checkpointed(contexts.registered(self.registrations, functions, roots, disabled, known))
        merged = contexts.merged_contexts(hardware, declared, auto, made)
        entries = hardware.select("context_id", "function_id").union(roots.select("context_id", "function_id")).union(auto.select("context_id", "function_id")).union(made.where("context_id is not null").select("context_id", "function_id"))
        if self.earlier["contexts"] is not None:
            merged = merged.unionByName(self.earlier["contexts"].select("context_id", "kind", "reentrant", "discovery").join(merged.select("context_id"), "context_id", "left_anti"))
            entries = entries.union(self.earlier["roots"].select("context_id", "function_id"))
        return checkpointed(merged), checkpointed(entries.distinct()), made

    @property
    def contexts(self) -> DataFrame:
        return self._contexts[0]

    @property
    def roots(self) -> DataFrame:
        return self._contexts[1]

    @cached_property
    def bindings(self) -> DataFrame:
        return checkpointed(graph.witness_paths(self.roots, self.edges))

    # ---- uncertainty

    @cached_property
    def unknowns(self) -> DataFrame:
        """Given uncertainties and those that each step leaves; an assembly reference of a context's entry is none."""
        calls, made = self.given["semantic_calls"], []
        if self.solved.hit:
            made.append(unknown("POINTS_TO_LIMIT", self.spark.range(1)))
        made.append(unknown("UNRESOLVED_REGISTERED_ENTRY", self.callbacks.where("function_id is null"), function_id="registered_by", file="file", line="line"))
        made.append(unknown("AMBIGUOUS_ENTRY_REGISTRATION", self.callbacks.join(self.registration_sites[0].where("how = 'AMBIGUOUS'").select("site").distinct(), "site", "left_semi"), function_id="registered_by", file="file", line="line"))
        made.append(unknown("UNMATCHED_ENTRY_REGISTRATION", self.registration_sites[1]))
        open_items = self.given["indirect_accesses"].join(self.item_places.select("item").distinct(), "item", "left_anti")
        made.append(unknown("UNRESOLVED_POINTEE", open_items, function_id="function_id", file="file", line="line"))
        resolved = self.transfers.where("symbol_id is not null")
        made.append(unknown("UNRESOLVED_DMA_BUFFER", self.transfers.join(resolved.select("site").distinct(), "site", "left_anti"), function_id="function_id", file="file", line="line"))
        made.append(unknown("DMA_SHARED_REVIEW", resolved, symbol_id="symbol_id", function_id="function_id", file="file", line="line"))
        made.append(unknown("UNRESOLVED_CONFIG_CALL", self.configured_edges.where("kind = 'UNRESOLVED_CONFIG_CALL'")))
        empty = [c["id"] for c in self.config.contexts if c.get("enabled", True)]
        if empty:
            listed = self.spark.createDataFrame([(c,) for c in empty], "context_id string")
            made.append(unknown("UNMATCHED_CONTEXT", listed.join(self.roots.select("context_id").distinct(), "context_id", "left_anti")))
        if self.config.auto_contexts:
            made.append(unknown("TASK_ENTRY_WITHOUT_DEFINITION", self.registrations.join(self.functions, "function_id", "left_anti"), target_function_id="function_id", file="file", line="line"))
            made.append(unknown("REGISTERED_CONTEXT_KIND_CONFLICT", self._contexts[2].where("context_id is null")))
        # A site that is open already is not open twice.
        told = self.given["unknowns"].where("kind = 'EXTERNAL_CALLEE'").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("function_id", "file")), F.coalesce("line", F.lit(-1)).alias("line")).distinct()
        external = graph.external_callees(self.calls, self.functions)
        external = external.withColumns({"f": F.coalesce("file", F.lit("")), "l": F.coalesce("line", F.lit(-1))}).join(told.withColumnsRenamed({"file": "f", "line": "l"}), ["function_id", "f", "l"], "left_anti")
        made.append(unknown("EXTERNAL_CALLEE", external, function_id="function_id", file="file", line="line"))
        rows = self.given["unknowns"].select(UNKNOWN)
        for m in made:
            rows = rows.unionByName(m)
        entries = self.bindings.where("call_depth = 0").select(F.col("function_id").alias("target_function_id")).distinct().withColumn("entry", F.lit(True))
        rows = rows.join(entries, "target_function_id", "left").where("not (kind = 'ASSEMBLY_FUNCTION_REFERENCE' and coalesce(entry, false))")
        return checkpointed(rows.select(UNKNOWN))

    @cached_property
    def flows(self) -> dict[str, DataFrame]:
        """What kinds of uncertainty, starts besides the contexts, and functions of external linkage reach."""
        starts = self.unknowns.where("target_function_id is not null").select(F.col("target_function_id").alias("function_id")).union(self.functions.where("attributed").select("function_id"))
        return graph.reach_groups({"kind": graph.taint_seeds(self.unknowns).withColumnRenamed("kind", "label"), "start": starts.select(F.lit("").alias("label"), "function_id"), "outside": graph.linked_outside(self.functions)}, self.edges)

    @cached_property
    def reach(self) -> DataFrame:
        opaque = self.unknowns.where("kind in ('EXTERNAL_CALLEE', 'INLINE_ASSEMBLY')").select("function_id").distinct()
        possible = graph.may_run(self.bindings.select("function_id").union(self.flows["start"].select("function_id")), self.flows["outside"], opaque)
        complete = not {"PARSE_FAILED", "SOURCE_NOT_IN_DATABASE"} & set(self.config.build_gaps)
        return checkpointed(graph.reachability(self.functions, self.bindings, possible, self.unknowns, complete))

    # ---- findings

    @cached_property
    def profile(self) -> DataFrame:
        """One wide row a variable; see rules.profile."""
        g, c = self.given, self.config
        live = rules.with_contexts(self.touched, self.bindings, self.contexts, self.reach)
        taints = self.flows["kind"].withColumnRenamed("label", "kind")
        return checkpointed(rules.profile(self.variables, live, self.unknowns, taints, self.reach, g["snapshots"], g["protection_events"], g["resources"], g["protection"], c.modelled, c.word_bytes, c.build_gaps))

    @cached_property
    def findings(self) -> DataFrame:
        """Findings of variables, and of gaps that belong to none."""
        return rules.findings(self.profile).unionByName(rules.gap_findings(rules.gap_groups(self.unknowns)))

    def coverage(self) -> DataFrame:
        """metric, value: functions, those with a context and those that can never run, accesses that can never run or have no context, variables by their lists, uncertainties."""
        dead = F.coalesce(F.col("reachability") == "PROVEN_UNREACHABLE", F.lit(False))
        covered = self.reach.join(self.bindings.select("function_id").distinct().withColumn("bound", F.lit(True)), "function_id", "left")
        reached = self.touched.select("function_id", "n").join(covered, "function_id", "left")
        parts = [covered.agg(F.count("*").alias("functions_total"), F.count("bound").alias("functions_with_context"), F.count_if(dead).alias("unreachable_functions")),
                 reached.agg(*(F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)).alias(name) for name, where in (("unreachable_accesses", dead), ("unknown_accesses", F.col("bound").isNull() & ~dead)))),
                 rules.accountability(self.profile).select(F.col("total").alias("variables_total"), "screened", "queued"), self.unknowns.agg(F.count("*").alias("uncertainties_total"))]
        return reduce(DataFrame.union, (p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in p.columns)))) for p in parts))
