"""Compile commands: words of a shell command, response files, and what a parser needs of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.graph import checkpointed, watched

BLANK = r" \t\r\n"
#: One piece of a word: plain text, an escaped character, or a quoted part; possessive, so that no command needs stack.
PIECE = rf"""(?s)(?:[^{BLANK}"'\\]++|\\.|'[^']*+'|"(?:[^"\\]++|\\.)*+")"""
#: More nested response files than this are refused.
DEPTH = 20
#: Options that only name outputs or steps, with a value of their own, without, and with the value joined on.
WITH_VALUE, ALONE = ["-o", "-MF", "-MT", "-MQ", "-MJ"], ["-c", "-S", "-E", "-MD", "-MMD", "-MP", "-MG"]


def well_quoted(command: Column) -> Column:
    """Whether all quotes close and no backslash stands last."""
    return F.rlike(command, F.lit(rf"\A(?:[{BLANK}]++|{PIECE})*+\z"))


def _plain(piece: Column) -> Column:
    """A piece without its quotes and escapes: none count in '...', only those of " and \\ in "..."."""
    inside = F.substring(piece, F.lit(2), F.length(piece) - 2)
    return F.when(F.startswith(piece, F.lit("'")), inside).when(F.startswith(piece, F.lit('"')), F.regexp_replace(inside, r'\\(["\\])', "$1")).when(F.startswith(piece, F.lit("\\")), F.substring(piece, 2, 1)).otherwise(piece)


def words(command: Column) -> Column:
    """The words of a command, as a POSIX shell splits them without expanding anything; null if it is not well quoted."""
    found = F.regexp_extract_all(command, F.lit(f"({PIECE}++)"), F.lit(1))
    return F.when(well_quoted(command), F.transform(found, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"({PIECE})"), F.lit(1)), _plain), "")))


def resolved(path: Column) -> Column:
    """An absolute path without . and .. parts."""
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def at(directory: Column, path: Column) -> Column:
    return resolved(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(directory, F.lit("/"), path)))


def expand_responses(arguments: DataFrame, files: DataFrame) -> DataFrame:
    """tu, arguments, response_files, problem: every @file replaced by the words of its text, in its place, however nested.

    arguments: tu, directory, arguments; files: path, content. Paths count from
    the unit's directory. A file within itself is a CYCLE, more than DEPTH
    nested ones are TOO_DEEP, others may be MISSING or badly QUOTEd; the first
    problem in order leaves the arguments null. A unit's own words stay in its
    row; what a reference of a directory stands for is opened once.
    """
    refers = lambda a: F.startswith(a, F.lit("@"))
    arguments = arguments.where(F.size("arguments") > 0)
    named = arguments.select("directory", F.explode(F.array_distinct(F.filter("arguments", refers))).alias("arg")).distinct()
    opened = checkpointed(_opened(named.select(F.struct("directory", "arg").alias("tu"), "directory", F.array("arg").alias("arguments")), files))
    known = opened.select(F.col("tu.directory").alias("of"), F.col("tu.arg").alias("ref"), F.struct(F.col("arguments").alias("words"), "response_files", "problem").alias("stands"))
    uses = arguments.select("tu", "directory", F.posexplode("arguments").alias("pos", "arg")).where(refers(F.col("arg")))
    each = uses.join(known, F.col("directory").eqNullSafe(F.col("of")) & (F.col("arg") == F.col("ref"))).groupBy("tu").agg(F.array_sort(F.collect_list(F.struct("pos", "stands"))).alias("each"))
    rows = arguments.select("tu", "arguments").join(each, "tu", "left").withColumn("each", F.coalesce("each", F.array().cast(each.schema["each"].dataType)))
    full = F.flatten(F.transform("arguments", lambda a, i: F.when(refers(a), F.get(F.filter("each", lambda e: e["pos"] == i), F.lit(0))["stands"]["words"]).otherwise(F.array_compact(F.array(a)))))
    problem = F.get(F.filter(F.transform("each", lambda e: e["stands"]["problem"]), lambda p: p.isNotNull()), F.lit(0))
    rows = rows.withColumn("problem", problem)
    return rows.select("tu", F.when(F.col("problem").isNull(), full).alias("arguments"), F.array_sort(F.array_distinct(F.flatten(F.transform("each", lambda e: e["stands"]["response_files"])))).alias("response_files"), "problem")


def _opened(arguments: DataFrame, files: DataFrame) -> DataFrame:
    """expand_responses() word by word, level by level: each word is a row."""
    texts = files.select("path", words(F.regexp_replace("content", "^﻿", "")).alias("words"))
    front = arguments.select("tu", "directory", F.posexplode("arguments").alias("pos", "arg")).select("tu", "directory", F.array("pos").alias("place"), "arg", F.array().cast("array<string>").alias("within"))
    done = []
    for _ in range(DEPTH + 3):
        front, n = watched(front, refers=F.count_if(F.startswith("arg", F.lit("@"))))
        refers = F.startswith("arg", F.lit("@"))
        done.append(front.where(~refers).select("tu", "place", "arg", F.lit(None).cast("string").alias("problem"), "within"))
        if not n["refers"]:
            break
        opened = front.where(refers).withColumn("path", at(F.col("directory"), F.substring("arg", F.lit(2), F.length("arg")))).join(texts.withColumn("known", F.lit(True)), "path", "left")
        problem = F.when(F.array_contains("within", F.col("path")), "CYCLE").when(F.size("within") > DEPTH, "TOO_DEEP").when(F.col("known").isNull(), "MISSING").when(F.col("words").isNull(), "QUOTE")
        opened = opened.withColumn("problem", problem).withColumn("within", F.array_append("within", F.col("path")))
        done.append(opened.where("problem is not null or size(words) = 0").select("tu", "place", F.lit(None).cast("string").alias("arg"), "problem", "within"))
        front = opened.where("problem is null").select("tu", "directory", "place", F.posexplode("words").alias("pos", "arg"), "within").select("tu", "directory", F.array_append("place", F.col("pos")).alias("place"), "arg", "within")
    every = reduce(DataFrame.unionByName, done)
    one = every.groupBy("tu").agg(F.array_sort(F.collect_list(F.when(F.col("arg").isNotNull(), F.struct("place", "arg")))).alias("a"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("problem"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("within")))).alias("response_files"))
    return one.select("tu", F.when(F.col("problem").isNull(), F.col("a.arg")).alias("arguments"), "response_files", "problem")


def _filtered(args: Column, directory: Column, source: Column, removed: list[str]) -> Column:
    """kept and removed arguments, in order; an option with a value takes the next argument with it."""
    text = lambda: F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("skip"), text().alias("kept"), text().alias("removed"))

    def step(a, arg):
        joined = reduce(Column.__or__, [F.startswith(arg, F.lit(p)) for p in WITH_VALUE])
        takes = ~a["skip"] & arg.isin(WITH_VALUE)
        own = ~F.startswith(arg, F.lit("-")) & (at(directory, arg) == source)
        out = a["skip"] | takes | arg.isin(ALONE) | joined | (arg.isin(removed) if removed else F.lit(False)) | own
        return F.struct(takes.alias("skip"), F.when(out, a["kept"]).otherwise(F.array_append(a["kept"], arg)).alias("kept"), F.when(out, F.array_append(a["removed"], arg)).otherwise(a["removed"]).alias("removed"))

    return F.aggregate(args, start, step)


def normalised(entries: DataFrame, files: DataFrame, extra: list[str] | None = None, removed: list[str] | None = None) -> DataFrame:
    """tu, source, arguments, removed_arguments, response_files, target, problem of compile entries (tu, file, directory, command or arguments).

    A compiler cache in front and the compiler go, so do outputs, dependency
    files, steps and the source itself; `extra` comes last. A compiler named
    arm-none-eabi without a target gives that target. An entry without a command
    is EMPTY, one with open quotes a QUOTE problem; others are those of
    expand_responses().
    """
    e = entries.withColumn("raw", F.when(F.size(F.coalesce("arguments", F.array().cast("array<string>"))) > 0, F.col("arguments")).otherwise(words(F.coalesce("command", F.lit("")))))
    e = checkpointed(e.select("tu", "directory", at(F.col("directory"), F.col("file")).alias("source"), "raw", F.when(F.col("raw").isNull(), "QUOTE").when(F.size("raw") == 0, "EMPTY").alias("bad")))
    full = expand_responses(e.where("bad is null").select("tu", "directory", F.col("raw").alias("arguments")), files)
    e = e.join(full, "tu", "left").withColumn("problem", F.coalesce("bad", "problem"))
    cached = F.rlike(F.get("arguments", F.lit(0)), F.lit(r"(?i)(?:^|/)s?ccache(?:\.[^/.]*)?$"))
    e = e.withColumn("args", F.when(cached, F.slice("arguments", F.lit(2), F.size("arguments"))).otherwise(F.col("arguments")))
    e = e.withColumn("compiler", F.get("args", F.lit(0))).withColumn("f", _filtered(F.slice("args", F.lit(2), F.size("args")), F.col("directory"), F.col("source"), removed or []))
    more = F.array(*map(F.lit, extra or [])).cast("array<string>")
    given = F.exists(F.concat("f.kept", more), lambda x: F.rlike(x, F.lit("^(?:--target|-target)")))
    target = F.when(F.contains(F.lower("compiler"), F.lit("arm-none-eabi")) & ~given, "arm-none-eabi")
    e = e.withColumn("target", target)
    arguments = F.concat("f.kept", F.when(F.col("target").isNotNull(), F.array(F.concat(F.lit("--target="), "target"))).otherwise(F.array().cast("array<string>")), more)
    ok = F.col("problem").isNull()
    return e.select("tu", "source", F.when(ok, arguments).alias("arguments"), F.when(ok, F.col("f.removed")).alias("removed_arguments"), F.coalesce("response_files", F.array().cast("array<string>")).alias("response_files"), F.when(ok, F.col("target")).alias("target"), "problem")
