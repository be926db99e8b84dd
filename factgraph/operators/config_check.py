"""Checks of project configurations as rows: one for each rule that a configuration breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of contexts and of registered entries, and the fields that some sections may have.
CONTEXT_KINDS, ENTRY_KINDS = ["ISR", "TASK", "MAIN", "CALLBACK", "DMA", "CORE"], ["ISR", "TASK", "CALLBACK"]
ENTRY_FIELDS = ["api", "callback_arg", "kind", "context_id", "may_repeat"]
CMAKE_FIELDS = ["build_dir", "generator", "build_type", "toolchain_file", "args", "build", "build_args", "clean_before_configure", "timeout_seconds"]
MAPPINGS, LISTS = ["project", "analysis", "review", "api_patterns"], ["contexts", "concurrency", "preemption", "call_edges", "entry_registrations", "resources", "protection", "known_safe"]
TEXT_LISTS, FOLDERS = ["extra_args", "remove_args", "exclude", "include_dirs", "exclude_dirs", "exclude_files", "expected_defines", "cmake_args"], ["include_dirs", "exclude_dirs", "exclude_files"]
FLAGS = [("analysis", "auto_contexts"), ("analysis", "auto_configure_cmake"), ("analysis", "auto_system_includes"), ("analysis", "open_report"), ("review", "enabled")]


def get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """JSON type of a value: null where there is none, else VOID, BOOLEAN, BIGINT, DOUBLE, DECIMAL, STRING, ARRAY or OBJECT."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def text(value: Column) -> Column:
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    return F.when(kind(value).isin("BIGINT", "DOUBLE", "DECIMAL"), F.try_variant_get(value, "$", "double"))


def items(value: Column) -> Column:
    return F.coalesce(F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def keys(value: Column) -> Column:
    return F.coalesce(F.when(kind(value) == "OBJECT", F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))), F.array().cast("array<string>"))


def filled(value: Column) -> Column:
    """A text that is not blank."""
    return F.coalesce(F.trim(text(value)) != "", F.lit(False))


def there(value: Column) -> Column:
    return value.isNotNull()


def texts(value: Column) -> Column:
    """A list of texts."""
    return (kind(value) == "ARRAY") & ~F.exists(items(value), lambda x: F.coalesce(kind(x), F.lit("")) != "STRING")


def whole(value: Column, low: int, high: int = 1 << 53) -> Column:
    return F.coalesce((kind(value) == "BIGINT") & number(value).between(low, high), F.lit(False))


def _broken(rules: list[tuple[str, Column]], path: Column) -> Column:
    """path, problem of the rules that hold, as an array."""
    found = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules)))
    return F.transform(found, lambda problem: F.struct(path.alias("path"), problem.alias("problem")))


def config_violations(configs: DataFrame) -> DataFrame:
    """config_id, path, problem: every rule that a configuration (config_id, config as JSON) breaks, wherever it stands.

    A text that is no JSON object of version 1 has that one problem. Sections
    that are missing are empty. Ids of contexts are unique and are what
    concurrency and preemption name; entries that share a context id share its
    kind, in their order and after the configured contexts. Regular expressions
    are checked as Java's, of which those of other engines mostly are. A text
    is read once, and all of its problems are found in its row.
    """
    # Few bytes that take long to judge: a small file would be one task, and so would a small shuffle that may be put together.
    spark = configs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    c = configs.select("config_id", "config").repartition(tasks, "config_id").select("config_id", F.try_parse_json("config").alias("c"))
    shaped = F.coalesce((kind(F.col("c")) == "OBJECT") & (number(get(F.col("c"), "$.version")) == 1), F.lit(False))
    of = lambda path: get(F.col("c"), f"$.{path}")
    at = lambda path, problem, holds: F.when(holds, F.struct(F.lit(f"$.{path}").alias("path"), F.lit(problem).alias("problem")))
    one, fields = [], {k: [] for k in ("project", "analysis", "analysis.cmake", "review")}  # what is looked up by path, all in one pass
    nothing = F.array().cast("array<struct<path:string,problem:string>>")
    one += [at(k, "NOT_A_MAPPING", there(of(k)) & (kind(of(k)) != "OBJECT")) for k in MAPPINGS]
    one += [at(k, "NOT_A_LIST_OF_MAPPINGS", there(of(k)) & ((kind(of(k)) != "ARRAY") | F.exists(items(of(k)), lambda x: F.coalesce(kind(x), F.lit("")) != "OBJECT"))) for k in LISTS]
    fields["project"].append(at("project.root", "EMPTY", there(of("project.root")) & ~filled(of("project.root"))))

    def each(section, rules_of):
        """What the rules of a section's mappings, rules_of(field, place), find."""
        own = lambda x, i: F.when(kind(x) == "OBJECT", _broken(rules_of(lambda k: x if k is None else get(x, f"$.{k}"), i), F.concat(F.lit(f"$.{section}["), i.cast("string"), F.lit("]"))))
        return F.flatten(F.array_compact(F.transform(items(of(section)), own)))

    def named(section, id_of):
        """id, kind of a section's entries in their places; id null where there is none."""
        return F.transform(items(of(section)), lambda x: F.struct(F.when(kind(x) == "OBJECT", id_of(x)).alias("id"), text(get(x, "$.kind")).alias("kind")))

    field = lambda k: lambda x: text(get(x, f"$.{k}"))
    c = c.withColumn("shaped", shaped).withColumn("own", F.when(F.col("shaped"), named("contexts", lambda x: F.when(filled(get(x, "$.id")), field("id")(x)))))
    c = c.withColumn("ids", F.col("own.id")).withColumn("chain", F.concat("own", named("entry_registrations", lambda x: F.when(field("context_id")(x) != "", field("context_id")(x)))))

    def context_rules(has, i):
        own = F.get(F.col("ids"), i)
        rules = [("ID_MISSING", own.isNull()), ("ID_TWICE", F.coalesce(F.array_position("ids", own) <= i, F.lit(False))), ("UNKNOWN_KIND", ~F.coalesce(text(has("kind")).isin(CONTEXT_KINDS), F.lit(False)))]
        rules += [(f"{f.upper()}_NOT_TEXTS", there(has(f)) & ~texts(has(f))) for f in ("functions", "patterns", "regex")]
        rules += [(f"{f.upper()}_NOT_A_FLAG", there(has(f)) & (kind(has(f)) != "BOOLEAN")) for f in ("enabled", "reentrant")]
        return [*rules, ("REGEX_INVALID", F.exists(F.transform(items(has("regex")), text), lambda r: r.isNotNull() & ~_compiles(r)))]

    listed = lambda v: F.coalesce(F.array_contains("ids", text(v)), F.lit(False))

    def entry_rules(has, i):
        given, before = text(has("context_id")), F.slice("chain", F.lit(1), F.size("own") + i)
        # Each kind of an id against the one before it: configured contexts first, of which the last of an id counts.
        same = F.filter(before, lambda s: s["id"] == given)
        was = F.try_element_at(same, F.lit(-1))
        return [("UNKNOWN_FIELD", F.size(F.array_except(keys(has(None)), F.array(*map(F.lit, ENTRY_FIELDS)))) > 0), ("API_EMPTY", ~filled(has("api"))), ("CALLBACK_ARG", ~whole(has("callback_arg"), 0)),
                ("UNKNOWN_KIND", ~F.coalesce(text(has("kind")).isin(ENTRY_KINDS), F.lit(False))), ("CONTEXT_ID_EMPTY", there(has("context_id")) & ~filled(has("context_id"))), ("MAY_REPEAT_NOT_A_FLAG", there(has("may_repeat")) & (kind(has("may_repeat")) != "BOOLEAN")),
                ("CONTEXT_KIND_CONFLICT", was.isNotNull() & ~text(has("kind")).eqNullSafe(was["kind"]))]

    lists = [each("contexts", context_rules), each("concurrency", lambda has, i: [
        ("NOT_TWO_CONTEXTS", (F.size(items(has("contexts"))) != 2) | F.exists(items(has("contexts")), lambda v: ~listed(v))),
        ("UNKNOWN_RELATION", there(has("relation")) & ~F.coalesce(text(has("relation")) == "may_interleave", F.lit(False)))]),
        each("preemption", lambda has, i: [("UNKNOWN_CONTEXT", ~listed(has("higher")) | ~listed(has("lower")))]), each("entry_registrations", entry_rules)]

    fields["analysis"] += [at(f"analysis.{k}", "NOT_TEXTS", there(of(f"analysis.{k}")) & ~texts(of(f"analysis.{k}"))) for k in TEXT_LISTS]
    fields["analysis"] += [at(f"analysis.{k}", "NOT_A_PATH", F.exists(F.transform(items(of(f"analysis.{k}")), text), lambda v: v.isNotNull() & ((F.trim(v) == "") | F.rlike(v, F.lit(r"[*?\[\]]"))))) for k in FOLDERS]
    cmake = of("analysis.cmake")
    fields["analysis.cmake"].append(at("analysis.cmake", "NOT_A_MAPPING", there(cmake) & (kind(cmake) != "OBJECT")))
    fields["analysis.cmake"].append(at("analysis.cmake", "UNKNOWN_FIELD", F.size(F.array_except(keys(cmake), F.array(*map(F.lit, CMAKE_FIELDS)))) > 0))
    old = F.exists(keys(of("analysis")), lambda k: F.startswith(k, F.lit("cmake_"))) | F.coalesce(F.try_variant_get(of("analysis.auto_configure_cmake"), "$", "boolean"), F.lit(False))
    fields["analysis.cmake"].append(at("analysis.cmake", "OLD_FIELDS_TOO", (kind(cmake) == "OBJECT") & old))
    fields["analysis.cmake"] += [at(f"analysis.cmake.{k}", "NOT_TEXTS", there(of(f"analysis.cmake.{k}")) & ~texts(of(f"analysis.cmake.{k}"))) for k in ("args", "build_args")]
    fields["analysis.cmake"] += [at(f"analysis.cmake.{k}", "EMPTY", there(of(f"analysis.cmake.{k}")) & ~filled(of(f"analysis.cmake.{k}"))) for k in ("build_dir", "generator", "build_type", "toolchain_file")]
    fields["analysis.cmake"] += [at(f"analysis.cmake.{k}", "NOT_A_FLAG", there(of(f"analysis.cmake.{k}")) & (kind(of(f"analysis.cmake.{k}")) != "BOOLEAN")) for k in ("build", "clean_before_configure")]
    for k in ("analysis.parse_timeout_seconds", "review.timeout_seconds", "analysis.cmake.timeout_seconds"):
        fields[k.rpartition(".")[0]].append(at(k, "NOT_POSITIVE", there(of(k)) & ~F.coalesce(number(of(k)) > 0, F.lit(False))))
    fields["review"] += [at(f"review.{k}", "NOT_A_COUNT", there(of(f"review.{k}")) & ~whole(of(f"review.{k}"), 0)) for k in ("retries", "max_items")]
    for s, k in FLAGS:
        fields[s].append(at(f"{s}.{k}", "NOT_A_FLAG", there(of(f"{s}.{k}")) & (kind(of(f"{s}.{k}")) != "BOOLEAN")))
    patterns = F.coalesce(F.map_entries(F.try_variant_get(of("api_patterns"), "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    lists.append(F.flatten(F.transform(patterns, lambda e: _broken([("NOT_TEXTS", ~F.coalesce(texts(e["value"]), F.lit(False)))], F.concat(F.lit("$.api_patterns."), e["key"])))))
    bits = of("project.native_word_bits")
    fields["project"].append(at("project.native_word_bits", "NOT_A_MULTIPLE_OF_8", there(bits) & ~F.coalesce(whole(bits, 1) & (number(bits) % 8 == 0), F.lit(False))))
    fields["review"].append(at("review.workers", "NOT_1_TO_8", there(of("review.workers")) & ~whole(of("review.workers"), 1, 8)))
    command = of("review.command")
    fields["review"].append(at("review.command", "NOT_A_LIST_OF_ARGUMENTS", there(command) & (~F.coalesce(texts(command), F.lit(False)) | (F.size(items(command)) == 0))))
    # Sections that are not there break none of the rules of their fields.
    when_there = F.flatten(F.array(*(F.when(there(of(section)), F.array_compact(F.array(*holds))).otherwise(nothing) for section, holds in fields.items())))
    no_mapping = F.array(F.struct(F.lit("$").alias("path"), F.lit("NOT_A_VERSION_1_MAPPING").alias("problem")))
    return c.select("config_id", F.inline(F.when(F.col("shaped"), F.concat(F.array_compact(F.array(*one)), when_there, *lists)).otherwise(no_mapping))).distinct()


def _compiles(pattern: Column) -> Column:
    """Whether brackets of a pattern are balanced and no quantifier stands alone; what the JVM would refuse beyond that is found where the pattern is used."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", "x"), r"\[\^?\]?[^\]]*\]", "x")
    depth = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok")), lambda a, ch: F.struct(F.when(ch == "(", a["n"] + 1).when(ch == ")", a["n"] - 1).otherwise(a["n"]).alias("n"), (a["ok"] & ~((ch == ")") & (a["n"] == 0))).alias("ok")))
    return depth["ok"] & (depth["n"] == 0) & ~F.contains(bare, F.lit("[")) & ~F.rlike(bare, F.lit(r"^[*+?]|[(|][*+?](?!:|=|!|<|P|i|s|m|x|-)|(?<!\\)\\$"))
