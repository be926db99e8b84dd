"""Digests, unions, diffs, manifests, coverage and merges of fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_digest(columns: list[str], n: int = 16) -> Column:
    """The first n hex digits of SHA-256 over the columns, by name, nulls told from ''."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in sorted(columns)]
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, n)


#: Characters that JSON texts escape, with their short forms.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(value: Column) -> Column:
    """A string as a JSON text: quotes, backslashes and control characters escaped, others as they are."""
    out = value
    for char, form in (ESCAPES | {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in ESCAPES}).items():
        out = F.replace(out, F.lit(char), F.lit(form))
    odd = F.rlike(value, F.lit(r'["\\\x00-\x1f]'))
    return F.concat(F.lit('"'), F.when(odd, out).otherwise(value), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A value of any nested type as JSON with sorted keys, ", " and ": " between parts, nulls as null, and characters beyond ASCII as they are.

    Numbers must be whole: floating-point numbers have several texts, so their type is refused.
    """
    if isinstance(kind, T.StringType):
        out = json_text(value)
    elif isinstance(kind, T.BooleanType):
        out = value.cast("string")
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.StructType):
        fields = [F.concat(json_text(F.lit(f.name)), F.lit(": "), canonical_json(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        # A null struct has null fields; its own text is null.
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))), ", "), F.lit("}"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def canonical_digest(df: DataFrame, columns: list[str], name: str = "digest", n: int = 64) -> DataFrame:
    """df with the first n hex digits of SHA-256 over the canonical JSON object of the columns."""
    kind = T.StructType([df.schema[c] for c in columns])
    return df.withColumn(name, F.substring(F.sha2(canonical_json(F.struct(*columns), kind), 256), 1, n))


def list_digest(n: int, *values: tuple[Column | str, T.DataType]) -> Column:
    """The first n hex digits of SHA-256 over the canonical JSON list of values, each with its type."""
    parts = [canonical_json(F.col(v) if isinstance(v, str) else v, t) for v, t in values]
    return F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256), 1, n)


def dedup_canonical(df: DataFrame) -> DataFrame:
    """Rows once each, by their canonical digest: also where columns are maps, which Spark does not compare."""
    return canonical_digest(df, df.columns, "_digest").dropDuplicates(["_digest"]).drop("_digest")


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out, *rest = parts
    for p in rest:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def baseline_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """finding_id, change: new, unchanged or no_longer_observed, which does not mean fixed."""
    a, b = now.select("finding_id").distinct().withColumn("now", F.lit(True)), before.select("finding_id").distinct().withColumn("before", F.lit(True))
    return a.join(b, "finding_id", "full").select("finding_id", F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "no_longer_observed").otherwise("unchanged").alias("change"))


def manifest_diff(now: DataFrame, before: DataFrame, ignored: list[str]) -> DataFrame:
    """path, change (added, removed, changed) of manifests (path, sha256), without the ignored paths."""
    j = now.withColumnRenamed("sha256", "now").join(before.withColumnRenamed("sha256", "before"), "path", "full").where(~F.col("path").isin(ignored) & ~F.col("now").eqNullSafe(F.col("before")))
    return j.select("path", F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def unlisted_sources(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files that no translation unit compiles."""
    return files.select("file").distinct().join(units.select("file"), "file", "left_anti")


def units_by_file(units: DataFrame) -> DataFrame:
    """file, tu: each unit under its source and every include, once; units has tu, file, includes."""
    return units.select("tu", F.explode(F.array_distinct(F.array_append("includes", F.col("file")))).alias("file"))


def file_coverage(files: DataFrame, units: DataFrame, fallbacks: DataFrame, variables: DataFrame, gaps: DataFrame) -> DataFrame:
    """file, parse_status, coverage_source, variable_count of every file.

    units and fallbacks: file, parse_status; a file's own units win over its
    fallbacks. NOT_COMPILED without either, PARSED or FAILED if all are, else
    PARTIAL; a gap makes it PARTIAL. Files without variables stay, with 0.
    """
    states = lambda df, p: df.groupBy("file").agg(F.bool_and(F.col("parse_status") == "PARSED").alias(f"{p}_ok"), F.bool_and(F.col("parse_status") == "FAILED").alias(f"{p}_bad"))
    n = variables.select("file", "symbol_id").distinct().groupBy("file").agg(F.count("*").alias("n"))
    f = files.select("file").distinct().join(states(units, "u"), "file", "left").join(states(fallbacks, "f"), "file", "left").join(n, "file", "left").join(gaps.select("file").distinct().withColumn("gap", F.lit(True)), "file", "left")
    own = F.col("u_ok").isNotNull()
    ok, bad = F.when(own, F.col("u_ok")).otherwise(F.col("f_ok")), F.when(own, F.col("u_bad")).otherwise(F.col("f_bad"))
    status = F.when(F.col("gap"), "PARTIAL").when(ok.isNull(), "NOT_COMPILED").when(ok, "PARSED").when(bad, "FAILED").otherwise("PARTIAL")
    return f.select("file", status.alias("parse_status"), F.when(own, "compile_database").otherwise("supplemental").alias("coverage_source"), F.coalesce("n", F.lit(0)).alias("variable_count"))


def merge_supplemental(variables: DataFrame, extra: DataFrame) -> DataFrame:
    """What becomes of supplemental declarations (symbol_id, name, kind, file, line, ord): ord, symbol_id, action.

    A declaration at a place already known (file, line, name, kind) is dropped;
    one of a known global's id is attached to it; one of another known id gets
    an id of its own; the rest are new. Earlier rows of `extra` count as known.
    """
    place = ["file", "line", "name", "kind"]
    known = variables.select(*place).distinct().withColumn("old", F.lit(True))
    e = extra.join(known, place, "left").withColumn("nth", F.row_number().over(Window.partitionBy(*place).orderBy("ord")))
    ids = variables.select("symbol_id").distinct().withColumn("has_id", F.lit(True))
    e = e.join(ids, "symbol_id", "left")
    dropped = F.col("old").isNotNull() | (F.col("nth") > 1)
    kept = e.where(~dropped).withColumn("first_of_id", F.row_number().over(Window.partitionBy("symbol_id").orderBy("ord")) == 1)
    collides = F.col("has_id").isNotNull() | ~F.col("first_of_id")
    own = F.concat(F.lit("decl::"), row_digest(place, 24))
    made = kept.select("ord", F.when(collides & (F.col("kind") != "GLOBAL"), own).otherwise(F.col("symbol_id")).alias("symbol_id"), F.when(~collides, "new").when(F.col("kind") == "GLOBAL", "attached").otherwise("renamed").alias("action"))
    return made.unionByName(e.where(dropped).select("ord", "symbol_id", F.lit("dropped").alias("action")))


def scan_valid(saved: DataFrame, current: DataFrame) -> DataFrame:
    """run_id, valid, differs: a saved scan holds only if every one of its digests is the current one's."""
    keys = [c for c in saved.columns if c != "run_id"]
    j = saved.alias("s").join(current.alias("c"), "run_id", "left")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")), F.lit(k)) for k in keys]))
    return j.select("run_id", (F.size(differs) == 0).alias("valid"), F.array_join(differs, ",").alias("differs"))


def local_ordinals(declared: DataFrame) -> DataFrame:
    """Locals (function_id, name, pos) with the ordinal, from 0, among those of the same name in their function."""
    return declared.withColumn("ordinal", F.row_number().over(Window.partitionBy("function_id", "name").orderBy("pos")) - 1)


def compile_entries(entries: DataFrame) -> DataFrame:
    """tu, file, directory, arguments of entries (tu, entry as JSON); an entry without a file raises."""
    e = entries.withColumn("e", F.from_json("entry", "file string, directory string, arguments array<string>"))
    no_file = F.raise_error(F.concat(F.lit("compile entry without a file: "), F.col("tu").cast("string")))
    return e.select("tu", F.when(F.coalesce("e.file", F.lit("")) == "", no_file.cast("string")).otherwise(F.col("e.file")).alias("file"), "e.directory", "e.arguments")


def effective_defines(units: DataFrame) -> DataFrame:
    """tu, macro, value after all -D and -U in order, each with its value joined or in the next argument; -U takes a macro away, no value means 1."""
    a = units.select("tu", F.posexplode("arguments").alias("pos", "arg"), "arguments")
    flag, after = F.substring("arg", 1, 2), F.substring("arg", 3, 1 << 30)
    value = F.when(after != "", after).otherwise(F.coalesce(F.get("arguments", F.col("pos") + 1), F.lit("")))
    d = a.where(flag.isin("-D", "-U")).select("tu", "pos", flag.alias("flag"), F.regexp_extract(value, "(?s)^([^=]*)", 1).alias("macro"), F.when(F.contains(value, F.lit("=")), F.regexp_extract(value, "(?s)^[^=]*=(.*)$", 1)).otherwise("1").alias("value"))
    last = d.where("macro <> ''").groupBy("tu", "macro").agg(F.max_by(F.struct("flag", "value"), "pos").alias("x"))
    return last.where("x.flag = '-D'").select("tu", "macro", "x.value")


def missing_defines(defines: DataFrame, units: DataFrame, expected: list[str]) -> DataFrame:
    """tu, expected: expected NAME or NAME=value that a unit's defines do not meet."""
    e = units.select("tu", F.explode(F.array(*map(F.lit, expected))).alias("expected"))
    e = e.withColumn("macro", F.regexp_extract("expected", "^([^=]*)", 1)).withColumn("want", F.when(F.contains("expected", F.lit("=")), F.regexp_extract("expected", "(?s)=(.*)$", 1)))
    return e.join(defines, ["tu", "macro"], "left").where("value is null or want <> value").select("tu", "expected")


SUFFIXES = ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "inc"]


def source_files(paths: DataFrame, suffixes: list[str] = SUFFIXES, pruned: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """Paths whose suffix, in any case, is a source's and none of whose folders is pruned."""
    folders = F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1)
    return paths.where(F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1)).isin(suffixes) & ~F.arrays_overlap(folders, F.array(*map(F.lit, pruned)))).select("file")
