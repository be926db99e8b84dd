"""Audit scope: which paths and variables belong to it, and what it leaves out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the reason of a variable that is in no include_dirs or has no owner.
OUTSIDE = "不在 include_dirs 内或归属未确定"


@dataclass
class Scope:
    """Folders and files relative to the project; no include_dirs means all."""

    include_dirs: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=list)
    exclude_files: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression of whole names; in a set only a leading ! and ranges mean something."""
    parts = {"*": ".*", "?": "."}

    def turned(piece: str) -> str:
        if len(piece) == 1:
            return parts.get(piece) or re.escape(piece)
        inside, no = (piece[2:-1], "^") if piece[1] == "!" else (piece[1:-1], "")
        return "[" + no + re.sub(r"[\[\]\\^&~|]", r"\\\g<0>", inside) + "]"

    return "(?s)^" + "".join(map(turned, re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S))) + "$"


def relative_path(path: Column, root: str) -> Column:
    """Path below root with forward slashes; other paths stay absolute."""
    p, root = F.replace(path, F.lit("\\"), F.lit("/")), root.rstrip("/")
    return F.when(p == root, ".").when(F.startswith(p, F.lit(root + "/")), F.substring(p, F.lit(len(root) + 2), F.length(p))).otherwise(p)


def under(path: Column, folder: str) -> Column:
    return (path == folder) | F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def exclusion_reason(path: Column, scope: Scope) -> Column:
    """Label of the first exclusion that holds: folders, then files, then older patterns; null if none does."""
    tests = [(under(path, d), "exclude_dirs: " + d) for d in scope.exclude_dirs] + [(path == f, "exclude_files: " + f) for f in scope.exclude_files]
    tests += [(F.rlike(path, F.lit(glob_regex(x))) if re.search(r"[*?\[]", x) else under(path, x), "exclude: " + x) for x in scope.exclude]
    return F.coalesce(*[F.when(hold, label) for hold, label in tests], F.lit(None).cast("string"))


def contains(path: Column, scope: Scope) -> Column:
    """Whether a path is in an included folder and not excluded; false for null and ''."""
    inside = reduce(Column.__or__, [under(path, d) for d in scope.include_dirs]) if scope.include_dirs else F.lit(True)
    return F.coalesce((path != "") & inside & exclusion_reason(path, scope).isNull(), F.lit(False))


def variable_reason(scope: Scope) -> Column:
    """Why a variable is left out, or null. Its definitions own it, its declarations only if it has none; any excluded path excludes it."""
    paths = F.when(F.coalesce("definition_file", F.lit("")) != "", F.array("definition_file")).otherwise(F.array_compact(F.array("declaration_file")))
    excluded = F.transform(F.array_sort(paths), lambda p: exclusion_reason(p, scope))
    return F.when(F.exists(excluded, lambda r: r.isNotNull()), F.get(F.array_compact(excluded), F.lit(0))).when((F.size(paths) == 0) | ~F.forall(paths, lambda p: contains(p, scope)), OUTSIDE)


def select_variables(variables: DataFrame, scope: Scope) -> DataFrame:
    return variables.where(variable_reason(scope).isNull())


def exclusion_counts(variables: DataFrame, scope: Scope) -> DataFrame:
    """file, reason, n_variables of what is left out."""
    v = variables.withColumn("reason", variable_reason(scope)).where("reason is not null")
    return v.groupBy(F.coalesce("definition_file", "declaration_file").alias("file"), "reason").agg(F.count("*").alias("n_variables"))


def keep_unknowns(unknowns: DataFrame, selected: DataFrame, relevant: DataFrame, scope: Scope) -> DataFrame:
    """Uncertainties with `kept`: of selected symbols; failed parses; those without a file; in scope; or in functions that lead to selected symbols."""
    u = unknowns.join(selected.select("symbol_id").distinct().withColumn("chosen", F.lit(True)), "symbol_id", "left")
    here = relevant.select("function_id").distinct()
    u = u.join(here.withColumn("caller_in", F.lit(True)), "function_id", "left").join(here.select(F.col("function_id").alias("target_function_id")).withColumn("target_in", F.lit(True)), "target_function_id", "left")
    near = F.coalesce("caller_in", F.lit(False)) | F.coalesce("target_in", F.lit(False))
    kept = F.when(F.col("symbol_id").isNotNull(), F.coalesce("chosen", F.lit(False))).when((F.col("kind") == "PARSE_FAILED") | (F.coalesce("file", F.lit("")) == ""), True).otherwise(contains(F.col("file"), scope) | near)
    return u.withColumn("kept", kept).drop("chosen", "caller_in", "target_in")


def leaks(output: DataFrame, variables: DataFrame, scope: Scope) -> DataFrame:
    """Rows of an output whose symbol is out of scope or unknown: there must be none."""
    return output.join(select_variables(variables, scope).select("symbol_id"), "symbol_id", "left_anti")


def closed(findings: DataFrame, variables: DataFrame, scope: Scope) -> DataFrame:
    """findings as they are; a row of a symbol that is out of scope or not listed raises, so that nothing with a leak can be written."""
    leaking = leaks(findings.where("symbol_id is not null"), variables, scope).select("finding_id").distinct().withColumn("leak", F.lit(True))
    fails = F.raise_error(F.concat(F.lit("out of scope: "), F.col("finding_id"))).cast("string")
    return findings.join(leaking, "finding_id", "left").withColumn("finding_id", F.when(F.col("leak"), fails).otherwise(F.col("finding_id"))).drop("leak")
