"""Several cores' scans as one: ids renamed in every table, shared objects under one id, the rules over the union."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators import multicore
from factgraph.operators.graph import checkpointed
from factgraph.plans.analysis import Config, Run

#: Columns and fields, at any depth, that hold ids of symbols, functions, contexts and accesses.
SYMBOLS, FUNCTIONS, CONTEXTS, ACCESSES = {"symbol_id"}, {"function_id", "caller", "callee", "target_function_id", "registered_by"}, {"context_id", "owner_context"}, {"access_id"}
TABLES = ["variables", "functions", "accesses", "calls", "unknowns", "protection_events", "snapshots", "contexts", "roots"]


@dataclass
class Variant:
    """One build of one core: its tables after its own run, and its image's objects (name, address, size, binding, file). The table of accesses is read more than once: it should be written, not derived."""

    core: str
    tables: dict[str, DataFrame]
    objects: DataFrame


def _walk(value: Column, kind: T.DataType, name: str, leaf) -> Column:
    """value with leaf(text, field name) in place of every text, through structs, arrays and maps."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_walk(value.getField(f.name), f.dataType, f.name, leaf).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _walk(x, kind.elementType, name, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _walk(x, kind.valueType, name, leaf))
    return leaf(value, name) if isinstance(kind, T.StringType) else value


def _symbols(value: Column, kind: T.DataType, name: str) -> Column | None:
    """All symbol ids within a value, as an array; null if its type has no place for one."""
    if isinstance(kind, T.StructType):
        return _united([_symbols(value.getField(f.name), f.dataType, f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        own = _symbols(F.lit(None).cast(kind.elementType), kind.elementType, name)
        return None if own is None else F.flatten(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: _symbols(x, kind.elementType, name)))
    if isinstance(kind, T.MapType):
        return _symbols(F.map_values(value), T.ArrayType(kind.valueType), name)
    return F.array_compact(F.array(value)) if isinstance(kind, T.StringType) and name in SYMBOLS else None


def _united(parts: list[Column | None]) -> Column | None:
    some = [F.coalesce(p, F.array().cast("array<string>")) for p in parts if p is not None]
    return F.concat(*some) if some else None


def renamed(df: DataFrame, variant: str, ids: DataFrame) -> DataFrame:
    """df under the combined ids: symbols by ids (symbol_id, combined_id), others and functions as variant::id, contexts and accesses as variant:id. Empty ids stay.

    A column of symbols is joined as it is; only symbols within other columns need a key of their row.
    """
    of, fields = F.lit(None), df.schema.fields
    plain = [f.name for f in fields if f.name in SYMBOLS and isinstance(f.dataType, T.StringType)]
    found = _united([_symbols(F.col(f.name), f.dataType, f.name) for f in fields if f.name not in plain])
    if found is not None:
        rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
        pairs = rows.select("_row", F.explode(F.array_distinct(found)).alias("symbol_id")).join(ids.select("symbol_id", "combined_id"), "symbol_id")
        own = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("symbol_id", "combined_id"))).alias("_ids"))
        df, of = rows.join(own, "_row", "left").drop("_row"), F.col("_ids")
    for name in plain:
        df = df.join(ids.select(F.col("symbol_id").alias(name), F.col("combined_id").alias(f"_own_{name}")), name, "left")

    def leaf(value, name):
        long, short = F.concat(F.lit(f"{variant}::"), value), F.concat(F.lit(f"{variant}:"), value)
        if name in SYMBOLS:
            return F.coalesce(of[value], long)
        return F.when(value != "", long if name in FUNCTIONS else short).otherwise(value) if name in FUNCTIONS | CONTEXTS | ACCESSES else value

    own = lambda name: F.coalesce(f"_own_{name}", F.concat(F.lit(f"{variant}::"), name))
    return df.select(*((own(f.name) if f.name in plain else _walk(F.col(f.name), f.dataType, f.name, leaf)).alias(f.name) for f in fields))


class Combined:
    """The variants' tables in one, and a run over them."""

    def __init__(self, spark, variants: dict[str, Variant], regions: list[tuple[int, int]], config: Config | None = None):
        self.spark, self.variants, self.regions = spark, variants, regions
        self.config = config or Config()
        named = [v.tables["variables"].select(F.lit(name).alias("variant"), "symbol_id", "name", "definition_file") for name, v in variants.items()]
        objects = [v.objects.select(F.lit(name).alias("variant"), "name", "address", "size", "binding", "file") for name, v in variants.items()]
        self.ids = checkpointed(multicore.linked_objects(reduce(DataFrame.union, named), reduce(DataFrame.union, objects), regions))
        # An object that is not shared is variant::id, listed or not.
        self.shared = checkpointed(self.ids.where("shared").select("variant", "symbol_id", "combined_id").distinct())
        self.cores = spark.createDataFrame([(name, v.core) for name, v in variants.items()], "variant string, core string")
        self.tables = {t: self._union(t) for t in TABLES}
        self.run = Run(spark, self.tables, Config(auto_contexts=False, modelled=self.config.modelled, word_bytes=self.config.word_bytes, build_gaps=self.config.build_gaps))

    def _union(self, table: str) -> DataFrame:
        parts = []
        for place, (name, v) in enumerate(self.variants.items()):
            own = renamed(v.tables[table], name, self.shared.where(F.col("variant") == name))
            parts.append(own.withColumn("_place", F.lit(place)) if table == "variables" else own)
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if table == "accesses":  # many rows, which the run reads as they are
            return every
        if table != "variables":
            return checkpointed(every)
        # A shared object's row is that of the first variant; it has one for each at most.
        columns = [c for c in every.columns if c not in ("symbol_id", "_place")]
        return checkpointed(every.groupBy("symbol_id").agg(F.min_by(F.struct(*columns), "_place").alias("row")).select("symbol_id", "row.*"))

    def instances(self) -> DataFrame:
        """combined_id, variant, core, symbol_id of every variable."""
        return self.ids.join(F.broadcast(self.cores), "variant").select("combined_id", "variant", "core", "symbol_id")

    def findings(self) -> DataFrame:
        """The run's findings; those of objects that several cores link have GS-CROSS-CORE too."""
        cross = multicore.cross_core(self.ids, self.cores).select(F.col("combined_id").alias("symbol_id"), F.array("rule").alias("more"))
        found = self.run.findings.join(cross, "symbol_id", "left")
        return found.withColumn("rules", F.array_sort(F.array_union("rules", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
