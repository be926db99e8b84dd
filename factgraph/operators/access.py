"""Access modes and call semantics from syntax relations and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.intervals import points_in_ranges
from factgraph.operators.scope import glob_regex

#: Library calls that read or write through an argument, and hardware buffers by argument.
API_SEMANTICS = [("memcpy", 0, "WRITE"), ("memcpy", 1, "READ"), ("memmove", 0, "WRITE"), ("memmove", 1, "READ"), ("memset", 0, "WRITE"), ("memcmp", 0, "READ"), ("memcmp", 1, "READ")]
DMA_CONTRACTS = [
    ("HAL_UART_Receive_DMA", 1, "WRITE", "rx"), ("HAL_UART_Transmit_DMA", 1, "READ", "tx"), ("HAL_SPI_Receive_DMA", 1, "WRITE", "rx"),
    ("HAL_SPI_Transmit_DMA", 1, "READ", "tx"), ("HAL_ADC_Start_DMA", 1, "WRITE", "rx"),
]
COMPOUND = ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="]
#: Spellings by the parser's numbers of operator kinds.
UNARY_KINDS = {1: "++", 2: "--", 3: "++", 4: "--", 5: "&", 6: "*", 7: "+", 8: "-", 9: "~", 10: "!"}
BINARY_KINDS = {
    3: "*", 4: "/", 5: "%", 6: "+", 7: "-", 8: "<<", 9: ">>", 11: "<", 12: ">", 13: "<=", 14: ">=", 15: "==", 16: "!=", 17: "&", 18: "^", 19: "|", 20: "&&", 21: "||",
    22: "=", 23: "*=", 24: "/=", 25: "%=", 26: "+=", 27: "-=", 28: "<<=", 29: ">>=", 30: "&=", 31: "^=", 32: "|=", 33: ",",
}
ANCESTOR = ["distance", "kind", "op", "child", "same_symbol", "is_array", "decays", "arrow", "name"]


def _chains(ancestors: DataFrame) -> DataFrame:
    """ref, up: each reference's ancestors from the nearest on, as far as its tree is deep."""
    return ancestors.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct(*ANCESTOR))).alias("up"))


def access_mode(ancestors: DataFrame, through_pointer: bool = False) -> DataFrame:
    """ref, mode, path of each reference from its ancestors.

    ancestors: ref, distance, kind, op, child (0: left or base), same_symbol
    (the right side names the object too), is_array (the object is one), decays
    (a wrapper that turns an array into a pointer), arrow (a member by ->),
    name (of a member). Wrappers, members by a point and elements of the base
    are passed and make the path, outermost first; the first other ancestor
    decides: ++ and -- and compound assignment to it give RMW, = gives WRITE
    (RMW with same_symbol), & and an array that goes to a call without a member
    or element give ADDRESS_TAKEN, sizeof gives no access (null), all else READ.
    A read of an array that has decayed since its last element is
    ADDRESS_TAKEN. A member by -> and an index end the path as READ: what they
    reach is another object, as is anything through a pointer.
    """
    passed = lambda x: (x["kind"] == "WRAPPER") | ((x["kind"] == "MEMBER") & ~x["arrow"] & ~F.lit(through_pointer)) | ((x["kind"] == "SUBSCRIPT") & (x["child"] == 0) & ~F.lit(through_pointer))
    c = _chains(ancestors).withColumn("stop", F.get(F.filter("up", lambda x: ~passed(x)), F.lit(0)))
    c = c.withColumn("way", F.filter("up", lambda x: F.col("stop").isNull() | (x["distance"] < F.col("stop.distance"))))
    steps = F.transform(F.filter("way", lambda x: x["kind"] != "WRAPPER"), lambda x: F.when(x["kind"] == "MEMBER", x["name"]).otherwise("[]"))
    last = lambda test: F.coalesce(F.array_max(F.transform(F.filter("way", test), lambda x: x["distance"])), F.lit(-1))
    decayed = last(lambda x: x["decays"]) > last(lambda x: x["kind"] == "SUBSCRIPT")
    kind, op, left = F.col("stop.kind"), F.col("stop.op"), F.col("stop.child") == 0
    mode = (F.when(kind == "SIZEOF", None).when((kind == "UNARY") & op.isin("++", "--"), "RMW").when((kind == "UNARY") & (op == "&"), "ADDRESS_TAKEN")
            .when((kind == "BINARY") & (op == "=") & left, F.when(F.col("stop.same_symbol"), "RMW").otherwise("WRITE")).when((kind == "BINARY") & op.isin(COMPOUND) & left, "RMW")
            .when((kind == "CALL") & F.col("stop.is_array") & (F.size(steps) == 0), "ADDRESS_TAKEN").when(kind.isin("MEMBER", "SUBSCRIPT"), "READ").when(decayed, "ADDRESS_TAKEN").otherwise("READ"))
    return c.select("ref", mode.alias("mode"), F.when(~kind.eqNullSafe("SIZEOF"), F.array_join(F.reverse(steps), ".")).otherwise("").alias("path"))


def indirect_mode(ancestors: DataFrame) -> DataFrame:
    """ref, mode of each place that a pointer reaches, from the same ancestors: any member and base of an element is passed; & gives ADDRESS_TAKEN, ++ and -- and compound assignment RMW, = WRITE, sizeof none (null), all else READ."""
    passed = lambda x: x["kind"].isin("WRAPPER", "MEMBER") | ((x["kind"] == "SUBSCRIPT") & (x["child"] == 0))
    c = _chains(ancestors).withColumn("stop", F.get(F.filter("up", lambda x: ~passed(x)), F.lit(0)))
    kind, op, left = F.col("stop.kind"), F.col("stop.op"), F.col("stop.child") == 0
    mode = (F.when(kind == "SIZEOF", None).when((kind == "UNARY") & op.isin("++", "--"), "RMW").when((kind == "UNARY") & (op == "&"), "ADDRESS_TAKEN")
            .when((kind == "BINARY") & (op == "=") & left, "WRITE").when((kind == "BINARY") & op.isin(COMPOUND) & left, "RMW").otherwise("READ"))
    return c.select("ref", mode.alias("mode"))


def operator_text(kind: Column, unary: Column) -> Column:
    """Spelling of an operator by the number of its kind, '' for the rest."""
    of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[kind.cast("int")]
    return F.coalesce(F.when(unary, of(UNARY_KINDS)).otherwise(of(BINARY_KINDS)), F.lit(""))


def protection_kinds(calls: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """function_id, name, event_kind: a row for each kind one of whose shell patterns fits the called name."""
    hit = lambda globs: F.exists(F.array(*[F.lit(glob_regex(g)) for g in globs]), lambda p: F.rlike(F.col("name"), p))
    return calls.select("function_id", "name", F.explode(F.array_compact(F.array(*[F.when(hit(g), F.lit(k)) for k, g in patterns.items()]))).alias("event_kind"))


def argument_accesses(arguments: DataFrame) -> DataFrame:
    """site, arg, location, mode of library calls: arguments has site, name, arg, location."""
    dim = arguments.sparkSession.createDataFrame(API_SEMANTICS, "name string, arg int, mode string")
    return arguments.join(F.broadcast(dim), ["name", "arg"]).select("site", "arg", "location", "mode")


def dma_accesses(arguments: DataFrame) -> DataFrame:
    """site, location, mode, context_id of hardware transfers, and other calls with DMA in their name for review (mode null)."""
    dim = arguments.sparkSession.createDataFrame(DMA_CONTRACTS, "name string, arg int, mode string, direction string")
    known = arguments.join(F.broadcast(dim), ["name", "arg"]).select("site", "location", "mode", F.concat(F.lit("dma_"), "direction").alias("context_id"))
    names = [n for n, *_ in DMA_CONTRACTS]
    other = arguments.where(F.contains(F.upper("name"), F.lit("DMA")) & ~F.col("name").isin(names)).select("site").distinct()
    return known.unionByName(other.select("site", *[F.lit(None).cast("string").alias(c) for c in ("location", "mode", "context_id")]))


def macro_owner(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """site, function_id of the function around each macro site (file, pos): from its line to its end_line."""
    f = functions.select("file", "function_id", "line", "end_line")
    return points_in_ranges(sites, f, ["file"], "pos", "line", "end_line").select("site", "function_id")


def local_aliases(assigned: DataFrame, rounds: int = 3) -> DataFrame:
    """pointer, symbol_id: what a local pointer may name after so many passes over the assignments (pointer, symbol_id or other pointer)."""
    own = assigned.where("symbol_id is not null").select("pointer", "symbol_id").distinct()
    copies = assigned.where("source is not null").select("pointer", "source").distinct()
    for _ in range(rounds):
        own = own.union(copies.join(own.withColumnRenamed("pointer", "source"), "source").select("pointer", "symbol_id")).distinct()
    return own
