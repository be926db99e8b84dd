"""Execution contexts from configuration, names and registrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators.scope import glob_regex
from factgraph.operators.sets import canonical_json, list_digest

#: Exception handlers by name, and registration calls with their callback argument and kind.
HANDLERS = ["SysTick_Handler", "PendSV_Handler", "SVC_Handler", "NMI_Handler", "HardFault_Handler", "MemManage_Handler", "BusFault_Handler", "UsageFault_Handler"]
REGISTRATION_APIS = [
    ("xTaskCreate", 0, "TASK"), ("xTaskCreateStatic", 0, "TASK"), ("osThreadNew", 0, "TASK"), ("xTaskCreatePinnedToCore", 0, "TASK"), ("xTimerCreate", 4, "TIMER"), ("xTimerCreateStatic", 4, "TIMER"),
    ("xTimerPendFunctionCall", 0, "DEFERRED"), ("xTimerPendFunctionCallFromISR", 0, "DEFERRED"), ("NVIC_SetVector", 1, "ISR"),
]
TIMER_DAEMON = "auto:freertos:timer_daemon"


def names() -> Column:
    return F.array("name", "qualified_name", "function_id", F.concat("file", F.lit("::"), "name"))


def matches(spec: dict) -> Column:
    """Whether a function has one of the spec's names exactly, by shell pattern or by whole regular expression."""
    tests = [F.arrays_overlap(names(), F.array(*map(F.lit, spec["functions"])))] if spec.get("functions") else []
    patterns = [glob_regex(p) for p in spec.get("patterns", [])] + [f"^(?:{p})$" for p in spec.get("regex", [])]
    if patterns:
        tests.append(F.exists(names(), lambda n: reduce(Column.__or__, [F.rlike(n, F.lit(p)) for p in patterns])))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def match_specs(functions: DataFrame, specs: list[tuple[str, dict]]) -> DataFrame:
    """spec, function_id: each function with every spec that fits; the specs are configuration and become one expression."""
    found = F.array_compact(F.array(*[F.when(matches(s), F.lit(key)) for key, s in specs])) if specs else F.array().cast("array<string>")
    return functions.select(F.explode(found).alias("spec"), "function_id")


def configured_edges(functions: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """edge, caller, callee, kind: CONFIGURED if both ends match exactly one function, else UNRESOLVED_CONFIG_CALL without ends."""
    specs = [(f"{side}{i}", {"functions": [name]}) for i, edge in enumerate(edges) for side, name in zip("ab", edge, strict=True)]
    found = match_specs(functions, specs).groupBy("spec").agg(F.count("*").alias("n"), F.min("function_id").alias("function_id")).where("n = 1")
    listed = functions.sparkSession.createDataFrame([(i, f"a{i}", f"b{i}") for i in range(len(edges))], "edge int, a string, b string")
    end = lambda side, name: found.select(F.col("spec").alias(side), F.col("function_id").alias(name))
    both = listed.join(end("a", "caller"), "a", "left").join(end("b", "callee"), "b", "left")
    ok = F.col("caller").isNotNull() & F.col("callee").isNotNull()
    return both.select("edge", F.when(ok, F.col("caller")).alias("caller"), F.when(ok, F.col("callee")).alias("callee"), F.when(ok, "CONFIGURED").otherwise("UNRESOLVED_CONFIG_CALL").alias("kind"))


def auto_entry_kind() -> Column:
    """ISR or MAIN by a function's name, else null."""
    handler = ~F.startswith("name", F.lit("HAL_")) & (F.coalesce("parameter_count", F.lit(0)) == 0) & (F.endswith("name", F.lit("IRQHandler")) | F.col("name").isin(HANDLERS))
    return F.when(handler, "ISR").when(F.col("name") == "main", "MAIN")


def text_digest(n: int, column: Column | str) -> Column:
    """The first n hex digits of the canonical digest of one text."""
    return F.substring(F.sha2(canonical_json(F.col(column) if isinstance(column, str) else column, T.StringType()), 256), 1, n)


def configured_contexts(functions: DataFrame, specs: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts (also those without a function), their roots, and functions that a disabled one takes out of all discovery."""
    spark = functions.sparkSession
    on = [c for c in specs if c.get("enabled", True)]
    contexts = spark.createDataFrame([(c["id"], c["kind"], bool(c.get("reentrant", False)), "configured") for c in on], "context_id string, kind string, reentrant boolean, discovery string")
    roots = match_specs(functions, [(c["id"], c) for c in on]).withColumnRenamed("spec", "context_id")
    disabled = match_specs(functions, [(c["id"], c) for c in specs if not c.get("enabled", True)]).select("function_id").distinct()
    return contexts, roots, disabled


def auto_contexts(functions: DataFrame, taken: DataFrame) -> DataFrame:
    """context_id, kind, function_id of entries by name among functions that are not taken."""
    found = functions.withColumn("kind", auto_entry_kind()).where("kind is not null").join(taken, "function_id", "left_anti")
    return found.select(F.concat(F.lit("auto:"), "name", F.lit(":"), text_digest(8, "function_id")).alias("context_id"), "kind", "function_id")


#: Kinds that may run again before they end unless a registration says otherwise.
REPEATING = ["TASK", "CALLBACK"]


def registered(registrations: DataFrame, functions: DataFrame, matched: DataFrame, disabled: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Registrations that make or join a context, with its id: defined targets, once each, that no configuration has taken.

    ord orders them. Timers and deferred calls share one serial daemon, and so
    does the kernel's own timer task where registrations have api and
    registered_by. Those of one given id share the kind of the known context
    (context_id, kind) of that id, else the first one's; the others are
    conflicts (context_id null). Without may_repeat the kind decides.
    """
    key = ["function_id", "file", "pos", "kind", "given_id", F.when(F.col("configured"), F.col("may_repeat"))]
    r = registrations.withColumn("kind", F.coalesce("kind", F.lit("TASK")))
    r = r.join(functions.select("function_id", "name"), "function_id")
    r = r.join(matched.select("function_id").distinct().withColumn("matched", F.lit(True)), "function_id", "left").join(disabled, "function_id", "left_anti")
    r = r.where(F.col("matched").isNull() | F.col("configured"))
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where("nth = 1")
    r = r.withColumn("ordinal", F.row_number().over(Window.partitionBy("function_id", "file").orderBy("ord")))
    kernel = F.lit(False)
    if {"api", "registered_by"} <= set(registrations.columns):
        starts = functions.where("name = 'xTimerCreateTimerTask'").select(F.col("function_id").alias("registered_by")).distinct().withColumn("starts", F.lit(True))
        r = r.join(starts, "registered_by", "left")
        kernel = F.coalesce((F.col("name") == "prvTimerTask") & F.col("starts") & F.col("api").isin("xTaskCreate", "xTaskCreateStatic"), F.lit(False))
    serial = F.col("kind").isin("TIMER", "DEFERRED") | kernel
    r = r.withColumn("serial", serial)
    first = r.where(~F.col("serial") & F.col("given_id").isNotNull()).groupBy("given_id").agg(F.min_by("kind", "ord").alias("first_kind"))
    if known is not None:
        first = first.join(known.select(F.col("context_id").alias("given_id"), F.col("kind").alias("known_kind")), "given_id", "left").select("given_id", F.coalesce("known_kind", "first_kind").alias("first_kind"))
    r = r.join(first, "given_id", "left")
    own = F.concat(F.lit("auto:"), F.lower("kind"), F.lit(":"), "name", F.lit(":"), list_digest(12, ("function_id", T.StringType()), ("file", T.StringType()), ("ordinal", T.IntegerType())))
    context = F.when(F.col("serial"), TIMER_DAEMON).when(F.col("given_id").isNull(), own).when(F.col("kind") == F.col("first_kind"), F.col("given_id"))
    repeats = F.coalesce("may_repeat", F.when(F.col("given_id").isNull(), F.col("kind") == "TASK").otherwise(F.col("kind").isin(REPEATING)))
    return r.select(context.alias("context_id"), F.when(F.col("serial"), "TASK").otherwise(F.col("kind")).alias("kind"), (repeats & ~F.col("serial")).alias("may_repeat"), "function_id", "given_id", "ord", "ordinal")


def registration_contexts(made: DataFrame) -> DataFrame:
    """context_id, kind, reentrant (any registration may repeat), n_registrations."""
    return made.where("context_id is not null").groupBy("context_id", "kind").agg(F.bool_or("may_repeat").alias("reentrant"), F.count("*").alias("n_registrations"))


def undefined_entries(registrations: DataFrame, functions: DataFrame) -> DataFrame:
    """TASK_ENTRY_WITHOUT_DEFINITION: registrations of functions that are not defined."""
    return registrations.join(functions, "function_id", "left_anti").select(F.lit("TASK_ENTRY_WITHOUT_DEFINITION").alias("kind"), F.col("function_id").alias("target_function_id"), "file", "ord")


def match_registrations(calls: DataFrame, specs: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Sites with the registration spec that they use, and specs that no site uses.

    calls: site, name. A configured spec's api is a shell pattern and replaces
    the built-in ones; several that fit are all kept and flagged AMBIGUOUS.
    """
    spark = calls.sparkSession
    fit = F.array_compact(F.array(*[F.when(F.rlike("name", F.lit(glob_regex(s["api"]))), F.lit(f"spec{i}")) for i, s in enumerate(specs)])) if specs else F.array().cast("array<string>")
    built_in = F.array_compact(F.array(*[F.when(F.col("name") == api, F.lit(api)) for api, *_ in REGISTRATION_APIS]))
    c = calls.select("site", "name", fit.alias("fit")).select("site", "name", F.size("fit").alias("n"), F.explode(F.when(F.size("fit") > 0, F.col("fit")).otherwise(built_in)).alias("spec"))
    used = c.select("site", "name", "spec", F.when(F.col("n") > 1, "AMBIGUOUS").when(F.col("n") == 1, "CONFIGURED").otherwise("BUILT_IN").alias("how"))
    listed = spark.createDataFrame([(f"spec{i}", s["api"]) for i, s in enumerate(specs)], "spec string, api string")
    return used, listed.join(used.select("spec").distinct(), "spec", "left_anti")


def merged_contexts(hardware: DataFrame, configured: DataFrame, auto: DataFrame, made: DataFrame) -> DataFrame:
    """context_id, kind, reentrant, discovery of all contexts, in that order of sources.

    Configuration replaces a hardware context of its id; names make contexts of
    their own; registrations join a context that is there, which may repeat
    from then on if one of them may, or make one.
    """
    first = configured.select("context_id", "kind", "reentrant", "discovery", F.lit(0).alias("place"))
    first = first.unionByName(hardware.select("context_id", "kind", F.lit(False).alias("reentrant"), F.lit("argument_contract").alias("discovery"), F.lit(1).alias("place")).distinct())
    first = first.unionByName(auto.select("context_id", "kind", F.lit(False).alias("reentrant"), F.lit("name_convention").alias("discovery"), F.lit(2).alias("place")))
    kinds = F.when(F.col("context_id") == TIMER_DAEMON, "timer_daemon").when(F.col("given_id").isNotNull(), "registered_entry").otherwise("task_registration")
    later = made.where("context_id is not null").groupBy("context_id", "kind", kinds.alias("discovery")).agg(F.bool_or("may_repeat").alias("reentrant"))
    every = first.unionByName(later.select("context_id", "kind", "reentrant", "discovery", F.lit(3).alias("place")))
    best = F.min_by(F.struct("kind", "discovery"), "place")
    # Hardware contexts say nothing on reentrance; of the configured one and the registrations any may.
    return every.groupBy("context_id").agg(best.alias("best"), F.bool_or("reentrant").alias("reentrant")).select("context_id", "best.kind", "reentrant", "best.discovery")
