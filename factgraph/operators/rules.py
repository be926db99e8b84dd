"""Variable rules, screening and findings over accesses and their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators.sets import list_digest

WRITES, READS = ["WRITE", "RMW"], ["READ", "RMW"]
#: Kinds that leave every variable open, and kinds that leave those open that other code can name.
GLOBAL_GAPS = [
    "PARSE_FAILED", "POINTS_TO_LIMIT", "MULTIPLE_BUILD_VARIANTS", "SOURCE_CHANGED_DURING_SCAN", "HEADER_CHANGED_DURING_SCAN", "SOURCE_NOT_IN_DATABASE", "HEADERS_NOT_INCLUDED", "CPP_SEMANTICS_REVIEW",
    "UNMATCHED_ENTRY_REGISTRATION", "UNRESOLVED_REGISTERED_ENTRY", "AMBIGUOUS_ENTRY_REGISTRATION", "REGISTERED_CONTEXT_KIND_CONFLICT", "ASSEMBLY_SOURCE_REVIEW", "UNRESOLVED_CONFIG_CALL", "UNMATCHED_CONTEXT", "INLINE_ASSEMBLY",
]
EXTERNAL_GAPS = ["EXTERNAL_CALLEE", "INLINE_ASSEMBLY", "UNRESOLVED_POINTEE"]
INVENTORY_GAPS = ["SOURCE_NOT_IN_DATABASE", "HEADERS_NOT_INCLUDED", "PARSE_FAILED"]
FOREIGN_GAPS = ["EXTERNAL_CALLEE", "UNRESOLVED_POINTEE", "POINTER_DEREFERENCE"]
HIGH = ["GS-MULTI-WRITER", "GS-RMW-INTERLEAVE", "GS-LOCAL-STATIC-REENTRANT", "GS-STALE-SNAPSHOT", "GS-OWNER-VIOLATION"]
NO_PROOF = ["GS-NO-ACCESS-EVIDENCE", "GS-UNKNOWN-CONTEXT", "GS-COVERAGE-INCOMPLETE"]


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def function_contexts(bindings: DataFrame, contexts: DataFrame) -> DataFrame:
    """function_id, ids (sorted contexts), reentrant (any of them is)."""
    return bindings.join(F.broadcast(contexts.select("context_id", "reentrant")), "context_id", "left").groupBy("function_id").agg(F.array_sort(F.collect_set("context_id")).alias("ids"), F.coalesce(F.bool_or("reentrant"), F.lit(False)).alias("reentrant"))


def by_function(accesses: DataFrame) -> DataFrame:
    """Accesses of each symbol in each function, summed up: the step ahead of any join, so that hot symbols stay small."""
    kind = F.col("access_kind")
    escapes = (kind == "ADDRESS_TAKEN") | F.coalesce("via_alias", F.lit(False))
    site = F.when(kind.isin("READ", *WRITES), F.struct("file", "pos", "access_path", "access_kind"))
    # Rows of a group are in one partition already when its distinct sites are counted, which else takes two shuffles.
    rows = accesses.select("symbol_id", "function_id", "access_kind", "via_alias", "file", "pos", "access_path").repartition("symbol_id", "function_id")
    return rows.groupBy("symbol_id", "function_id").agg(
        F.count("*").alias("n"), F.bool_or(kind.isin(READS)).alias("reads"), F.bool_or(kind.isin(WRITES)).alias("writes"), F.bool_or(kind == "RMW").alias("rmw"),
        F.bool_and(kind == "READ").alias("only_reads"), F.bool_or(escapes).alias("escapes"), F.count_distinct(site).alias("sites"))


def live_accesses(accesses: DataFrame, bindings: DataFrame, contexts: DataFrame, reach: DataFrame) -> DataFrame:
    """by_function() with the function's contexts; live is false where it can never run."""
    return with_contexts(by_function(accesses), bindings, contexts, reach)


def with_contexts(touched: DataFrame, bindings: DataFrame, contexts: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows of by_function() with the function's contexts; live is false where it can never run."""
    x = touched.join(function_contexts(bindings, contexts), "function_id", "left").join(reach, "function_id", "left")
    return x.withColumns({"ids": F.coalesce("ids", strings([])), "reentrant": F.coalesce("reentrant", F.lit(False)), "live": F.coalesce(F.col("reachability") != "PROVEN_UNREACHABLE", F.lit(True))})


def union_of(when: Column, what) -> Column:
    """Sorted union of the arrays of the rows where it holds."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(when, F.col(what))))))


def readers_writers(live: DataFrame) -> DataFrame:
    """symbol_id, readers, writers, contexts: sorted contexts that read, write or touch it in functions that may run."""
    on = F.col("live")
    return live.groupBy("symbol_id").agg(union_of(on & F.col("reads"), "ids").alias("readers"), union_of(on & F.col("writes"), "ids").alias("writers"), union_of(on, "ids").alias("contexts"))


def tear_risk(word_bytes: int = 4) -> Column:
    size, align = F.col("size_bytes"), F.col("alignment_bytes")
    return F.coalesce(size.isNull() | (size > word_bytes) | align.isNull() | (align < F.least(size, F.lit(word_bytes))), F.lit(True))


def annotations(variables: DataFrame, resources: DataFrame) -> DataFrame:
    """symbol_id and the columns of each resource that has one of its names."""
    names = variables.select("symbol_id", F.explode(F.array_distinct(F.array("symbol_id", "name", "qualified_name"))).alias("resource"))
    return names.join(resources, "resource").drop("resource").distinct()


def profile(variables, live, unknowns, taints, reach, snapshots, events, resources, protection, modelled: bool = True, word_bytes: int = 4, build_gaps: list[str] | None = None) -> DataFrame:
    """One wide row for each variable: its contexts, rules, blockers, screening and grade.

    Accesses that can never run count for nothing but their number. Supplemental
    variables have the one rule GS-SUPPLEMENTAL-UNANALYZED. A screened variable
    has no rules. modelled is false for several cores or another scheduling;
    build_gaps are kinds that the build's coverage leaves open, without a place.
    """
    dead = reach.where("reachability = 'PROVEN_UNREACHABLE'").select("function_id")
    uncertain = unknowns.where(F.col("symbol_id").isNotNull()).join(dead, "function_id", "left_anti").groupBy("symbol_id").agg(F.lit(True).alias("uncertain"), F.bool_or(F.col("kind") == "DMA_SHARED_REVIEW").alias("dma"))
    loose = unknowns.where(F.col("symbol_id").isNull())
    alive = loose.join(dead, "function_id", "left_anti")
    kinds = lambda df, of: df.where(F.col("kind").isin(of)).agg(F.array_sort(F.collect_set("kind"))).scalar()
    always = [k for k in GLOBAL_GAPS if k != "INLINE_ASSEMBLY"]
    global_gaps = F.array_union(F.array_union(kinds(loose, always), kinds(alive, ["INLINE_ASSEMBLY"])), strings([*(build_gaps or []), *([] if modelled else ["UNMODELED_CONCURRENCY"])]))
    locks = events.where(F.col("event_kind").isin("lock_enter", "lock_exit")).select("function_id").distinct().withColumn("locks", F.lit(True))
    tainted = taints.groupBy("function_id").agg(F.array_sort(F.collect_set("kind")).alias("taints"))
    x = live.join(tainted, "function_id", "left").join(locks, "function_id", "left")
    on = F.col("live")
    per = x.groupBy("symbol_id").agg(
        union_of(on & F.col("reads"), "ids").alias("readers"), union_of(on & F.col("writes"), "ids").alias("writers"), union_of(on, "ids").alias("contexts"), union_of(on, "taints").alias("taints"),
        F.sum("n").alias("n_all"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("n_live"), F.sum(F.when(on, F.col("sites")).otherwise(0)).alias("sites"),
        F.bool_or(on & (F.size("ids") == 0)).alias("unknown_context"), F.bool_or(on & F.col("escapes")).alias("escapes"), F.bool_or(on & F.col("rmw")).alias("rmw"), F.bool_or(on & F.col("reentrant")).alias("reentrant"),
        F.bool_and(F.when(on, F.col("only_reads"))).alias("only_reads"), F.bool_or(on & F.coalesce("locks", F.lit(False))).alias("locks"))
    notes = annotations(variables, resources).groupBy("symbol_id").agg(F.array_sort(F.collect_set("owner_context")).alias("owners"), F.bool_or("business_critical").alias("critical"))
    declared = annotations(variables, protection.withColumn("declared", F.lit(True)))
    snaps = snapshots.select("symbol_id").distinct().withColumn("snapshot", F.lit(True))
    v = variables
    for other in (per, uncertain, notes, declared, snaps):
        v = v.join(other, "symbol_id", "left")
    flags = ["unknown_context", "escapes", "rmw", "reentrant", "only_reads", "locks", "uncertain", "dma", "critical", "declared", "snapshot"]
    arrays = ["readers", "writers", "contexts", "taints", "owners"]
    v = v.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, strings([])) for c in arrays} | {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_all", "n_live", "sites")})
    supplemental, failed, own = F.col("coverage_source") != "compile_database", F.col("parse_status") == "FAILED", (F.col("linkage") != "EXTERNAL") & ~F.col("escapes")
    shared = (F.size("contexts") >= 2) | F.col("reentrant")
    written = shared & (F.size("writers") > 0)
    rules = [
        ("GS-PARSE-INCOMPLETE", failed), ("GS-UNKNOWN-CONTEXT", F.col("unknown_context")), ("GS-INDIRECT-ACCESS", F.col("escapes") | F.col("uncertain")), ("GS-NO-ACCESS-EVIDENCE", (F.col("n_live") == 0) & ~F.col("is_const")),
        ("GS-DEFINITION-MISSING", F.coalesce("definition_file", F.lit("")) == ""), ("DMA_SHARED_REVIEW", F.col("dma")), ("GS-MULTI-CONTEXT", written), ("GS-MULTI-WRITER", written & ((F.size("writers") >= 2) | F.col("reentrant"))),
        ("GS-RMW-INTERLEAVE", written & F.col("rmw")), ("GS-STALE-SNAPSHOT", written & F.col("snapshot")), ("GS-LOCAL-STATIC-REENTRANT", written & (F.col("kind") == "LOCAL_STATIC")), ("GS-FILE-STATIC-SHARED", written & (F.col("kind") == "FILE_STATIC")),
        ("GS-TEAR-RISK", written & tear_risk(word_bytes)), ("GS-STRUCT-INCONSISTENT", written & (F.col("is_struct") | F.col("is_bitfield_container"))), ("GS-OWNER-VIOLATION", F.exists("owners", lambda o: F.size(F.array_except("writers", F.array(o))) > 0)),
    ]
    v = v.withColumn("shared", shared).withColumn("found", F.array_compact(F.array(*[F.when(hold, F.lit(name)) for name, hold in rules])))
    v = v.withColumn("global_gaps", global_gaps).withColumn("external_gaps", kinds(alive, EXTERNAL_GAPS))
    base = F.when(own, F.array_union(F.array_except("global_gaps", strings(INVENTORY_GAPS)), F.when(failed, strings(["PARSE_FAILED"])).otherwise(strings([])))).otherwise(F.col("global_gaps"))
    base = F.when(F.col("linkage") == "EXTERNAL", F.array_union(base, "external_gaps")).otherwise(base)
    v = v.withColumn("blockers", F.array_union(base, F.when(own, F.array_except("taints", strings(FOREIGN_GAPS))).otherwise(F.col("taints"))))
    only_reads = (F.col("n_live") > 0) & F.col("only_reads")
    v = v.withColumn("effective", F.when(only_reads, F.array_except("blockers", strings(["FUNCTION_ADDRESS", "INDIRECT_CALL"]))).otherwise(F.col("blockers")))
    one = (F.size("contexts") == 1) & ~F.col("reentrant") & ~F.col("unknown_context")
    clear = (F.size(F.array_except("found", strings(NO_PROOF))) == 0) & ~F.col("uncertain") & ~F.col("escapes") & (F.size("effective") == 0) & ~supplemental
    reason = F.when(F.col("n_live") == 0, F.when(F.col("n_all") > 0, "UNREACHABLE_ACCESSORS").otherwise("NO_RUNTIME_ACCESSES")).when(only_reads, "ONLY_READS").when(one & (F.col("sites") == 1), "SINGLE_ACCESS_SITE").when(one, "SINGLE_EXECUTION_CONTEXT")
    v = v.withColumn("screening_reason", F.when(clear, reason))
    screened = F.col("screening_reason").isNotNull()
    v = v.withColumn("rules", F.when(supplemental, strings(["GS-SUPPLEMENTAL-UNANALYZED"])).when(screened, strings([])).when(F.size("found") == 0, strings(["GS-COVERAGE-INCOMPLETE"])).otherwise(F.array_sort("found")))
    high = F.arrays_overlap("rules", strings(HIGH))
    v = v.withColumns({c: F.when(supplemental, strings([])).otherwise(F.col(c)) for c in ("readers", "writers", "contexts")})
    return v.select(
        "symbol_id", "name", "qualified_name", "kind", "linkage", "coverage_source", "parse_status", "definition_file", "readers", "writers", "contexts", "n_all", "n_live", "sites", "shared", "rules", "screening_reason",
        F.when(supplemental, "SUPPLEMENTAL_INVENTORY").when(screened, "SCREENED_NO_CONCURRENCY_RISK").otherwise("REVIEW_REQUIRED").alias("audit_status"),
        F.array_sort(F.when(supplemental, strings(["ACCESS_NOT_ANALYZED"])).when(screened, F.col("effective")).otherwise(F.col("blockers"))).alias("blockers"),
        F.when(supplemental, "UNKNOWN").when(F.col("locks"), "PARTIAL").when(F.col("declared"), "DECLARED_ONLY").otherwise("UNKNOWN").alias("protection_status"),
        F.when(F.size("rules") > 0, F.when(high & F.col("critical"), "CRITICAL").when(high, "HIGH").otherwise("MEDIUM")).alias("risk_level"),
        F.when(shared & ~supplemental, "MEDIUM").otherwise("LOW").alias("confidence"))


def findings(profiles: DataFrame) -> DataFrame:
    """A finding for each variable with a rule. Its id is the canonical digest of symbol, rules and contexts, without line numbers, so that edits keep it; that of a supplemental variable has no contexts."""
    texts = T.ArrayType(T.StringType())
    key = list_digest(16, ("symbol_id", T.StringType()), ("rules", texts), ("contexts", texts))
    extra = list_digest(16, ("symbol_id", T.StringType()), (F.lit("GS-SUPPLEMENTAL-UNANALYZED"), T.StringType()))
    return profiles.where(F.size("rules") > 0).select(
        F.concat(F.lit("GS-"), F.when(F.col("audit_status") == "SUPPLEMENTAL_INVENTORY", extra).otherwise(key)).alias("finding_id"), "symbol_id", F.col("qualified_name").alias("variable_name"), "rules", "contexts", "blockers", "risk_level", "confidence", "protection_status", "definition_file")


def gap_groups(unknowns: DataFrame) -> DataFrame:
    """Per kind and file of uncertainties without a symbol: rows, distinct functions, first line; the function only if there is exactly one."""
    at = F.coalesce("function_id", "target_function_id")
    return unknowns.where(F.col("symbol_id").isNull()).groupBy("kind", "file").agg(F.count("*").alias("n_rows"), F.count_distinct(at).alias("n_functions"), F.min("line").alias("first_line"), F.when(F.count_distinct(at) == 1, F.min(at)).alias("function_id"))


def gap_findings(groups: DataFrame) -> DataFrame:
    """Findings of the gap groups; file and kind make the id."""
    return groups.select(F.concat(F.lit("GAP-"), F.substring(F.sha2(F.concat_ws("|", "kind", F.coalesce("file", F.lit(""))), 256), 1, 16)).alias("finding_id"), F.lit(None).cast("string").alias("symbol_id"), F.col("kind").alias("variable_name"), F.array("kind").alias("rules"),
                         strings([]).alias("contexts"), strings([]).alias("blockers"), F.lit("MEDIUM").alias("risk_level"), F.lit("LOW").alias("confidence"), F.lit("UNKNOWN").alias("protection_status"), F.col("file").alias("definition_file"))


def accountability(profiles: DataFrame) -> DataFrame:
    """total, screened, queued; raises if a variable is in both lists, in none or there twice."""
    one = profiles.agg(F.count("*").alias("total"), F.count_distinct("symbol_id").alias("ids"), F.count("screening_reason").alias("screened"), F.count_if(F.size("rules") > 0).alias("queued"), F.count_if(F.col("screening_reason").isNotNull() == (F.size("rules") > 0)).alias("wrong"))
    fails = F.raise_error(F.lit("each variable must be either screened or queued, once"))
    return one.select(F.when((F.col("wrong") > 0) | (F.col("ids") < F.col("total")), fails.cast("long")).otherwise(F.col("total")).alias("total"), "screened", "queued")


def access_contexts(accesses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each access with the contexts of its function, sorted and comma-joined; '' if it has none."""
    by_id = bindings.groupBy("function_id").agg(F.array_sort(F.collect_set("context_id")).alias("ids"))
    return accesses.select("access_id", "symbol_id", "function_id").join(by_id, "function_id", "left").withColumn("contexts", F.coalesce(F.array_join("ids", ","), F.lit(""))).drop("ids")


def context_pairs(read_write: DataFrame) -> DataFrame:
    """symbol_id, first, second: pairs of its contexts. Contexts are few, so a symbol's list is short."""
    pairs = F.flatten(F.transform("contexts", lambda x: F.transform(F.filter("contexts", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return read_write.select("symbol_id", F.inline(pairs))


def configured_pairs(read_write: DataFrame, pairs: DataFrame) -> DataFrame:
    """symbol_id, higher, lower: configured pairs of which it has both contexts."""
    one = read_write.select("symbol_id", F.explode("contexts").alias("higher"))
    other = read_write.select("symbol_id", F.explode("contexts").alias("lower"))
    return one.join(F.broadcast(pairs.distinct()), "higher").join(other, ["symbol_id", "lower"]).select("symbol_id", "higher", "lower")


def configured_sets(read_write: DataFrame, sets: list[list[str]]) -> DataFrame:
    """symbol_id, place: configured sets of contexts, by their place in the configuration, all of which a symbol has; the sets become one expression."""
    held = F.array_compact(F.array(*(F.when(F.size(F.array_except(strings(s), "contexts")) == 0, F.lit(i)) for i, s in enumerate(sets)))) if sets else F.array().cast("array<int>")
    return read_write.select("symbol_id", F.explode(held).alias("place"))


def entry_distance(accesses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Functions on the shortest path from an entry of each context to an access of each symbol."""
    return accesses.select("symbol_id", "function_id").distinct().join(bindings, "function_id").groupBy("symbol_id", "context_id").agg((F.min("call_depth") + 1).cast("long").alias("entry_distance"))


def protection_evidence(accesses: DataFrame, events: DataFrame) -> DataFrame:
    """symbol_id, function_id with the number of its lock events; 0 if none."""
    counted = events.where(F.col("event_kind").isin("lock_enter", "lock_exit")).groupBy("function_id").agg(F.count("*").alias("n_events"))
    return accesses.select("symbol_id", "function_id").distinct().join(counted, "function_id", "left").fillna(0, ["n_events"]).select("symbol_id", "function_id", "n_events")


def merge_variables(rows: DataFrame) -> DataFrame:
    """One row for each symbol from the rows of several units, in part_ord.

    The first row gives the kind, the first with a definition gives the size; a
    failed parse of any unit stays; declarations are united in order of their
    first unit; another type in a later unit makes a type variant.
    """
    firsts = rows.groupBy("symbol_id", "declaration").agg(F.min("part_ord").alias("at")).groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("at", "declaration"))).alias("d"))
    one = rows.groupBy("symbol_id").agg(
        F.min_by("kind", "part_ord").alias("kind"), F.min_by("size_bytes", F.when(F.col("defined"), F.col("part_ord"))).alias("size_bytes"),
        F.bool_or("parse_failed").alias("parse_failed"), F.count("*").alias("n_units"), (F.count_distinct("type") > 1).alias("type_variant"))
    return one.join(firsts, "symbol_id").withColumn("declarations", F.array_join("d.declaration", ",")).drop("d")


def merge_functions(rows: DataFrame) -> DataFrame:
    """One row for each function_id: the last part's wins."""
    columns = [c for c in rows.columns if c not in ("function_id", "part_ord")]
    return rows.groupBy("function_id").agg(F.max_by(F.struct(*columns), "part_ord").alias("x")).select("function_id", "x.*")
