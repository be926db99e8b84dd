"""Several cores' scans in one: linked objects in shared memory, new ids, rules across cores."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elf_symbols(images: DataFrame) -> DataFrame:
    """path, ord, name, address, size, binding, type, defined of the symbol tables of 32-bit little-endian ARM images (path, content); another image raises."""
    def read(raw: bytes):
        if raw[:7] != b"\x7fELF\x01\x01\x01" or struct.unpack_from("<H", raw, 18)[0] != 40:
            raise ValueError("not a little-endian ELF32 ARM image")
        at, (step, n) = struct.unpack_from("<I", raw, 32)[0], struct.unpack_from("<HH", raw, 46)
        sections = [struct.unpack_from("<10I", raw, at + i * step) for i in range(n)]
        for _, kind, _, _, start, size, link, _, _, entry in sections:
            for place in range(start, start + size, entry or 16) if kind == 2 else ():
                name, address, length, info, _, section = struct.unpack_from("<IIIBBH", raw, place)
                begin = sections[link][4] + name
                yield raw[begin : raw.index(b"\0", begin)].decode("utf-8", "replace"), address, length, info >> 4, info & 15, section != 0

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, i, *s) for p, raw in zip(pdf.path, pdf.content, strict=True) for i, s in enumerate(read(raw))], columns=["path", "ord", "name", "address", "size", "binding", "type", "defined"])

    return images.select("path", "content").mapInPandas(run, "path string, ord int, name string, address long, size long, binding int, type int, defined boolean")


def elf_objects(symbols: DataFrame) -> DataFrame:
    """path, name, address, size, binding, file of defined data objects; the file symbol before them names their file, '' if there is none."""
    file = F.last(F.when(F.col("type") == 4, F.col("name")), ignorenulls=True).over(Window.partitionBy("path").orderBy("ord"))
    return symbols.withColumn("file", F.coalesce(file, F.lit(""))).where("type = 1 and defined and size > 0").select("path", "name", "address", "size", "binding", "file")


def linked_objects(variables: DataFrame, objects: DataFrame, regions: list[tuple[int, int]]) -> DataFrame:
    """variant, symbol_id, combined_id, shared: where exactly one object of its name fits (a private one also by file name) and lies in a shared region, the address is the id; else variant::id.

    variables: variant, symbol_id, name, definition_file; objects: variant, name, address, size, binding, file. Regions are configuration.
    """
    base = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)$", 1)
    fit = variables.join(objects, ["variant", "name"]).where((F.col("binding") != 0) | (base("file") == base("definition_file")))
    one = fit.groupBy("variant", "symbol_id").agg(F.count("*").alias("n"), F.min("address").alias("address"), F.min("size").alias("size")).where("n = 1")
    inside = F.exists(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(s + n).alias("e")) for s, n in regions]), lambda r: (r["s"] <= F.col("address")) & (F.col("address") + F.col("size") <= r["e"]))
    v = variables.select("variant", "symbol_id").join(one, ["variant", "symbol_id"], "left").withColumn("shared", F.coalesce(inside, F.lit(False)))
    shared_id = F.concat(F.lit("shared:0x"), F.lower(F.hex("address")), F.lit(":"), F.col("size").cast("string"))
    return v.select("variant", "symbol_id", F.when(F.col("shared"), shared_id).otherwise(F.concat_ws("::", "variant", "symbol_id")).alias("combined_id"), "shared")


def remap(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (variant, symbol_id, ...) under the combined ids; ids that are not listed get their variant in front."""
    new = F.coalesce("combined_id", F.concat_ws("::", "variant", "symbol_id"))
    return rows.join(ids.select("variant", "symbol_id", "combined_id"), ["variant", "symbol_id"], "left").withColumn("symbol_id", new).drop("combined_id")


def cross_core(ids: DataFrame, cores: DataFrame) -> DataFrame:
    """combined_id, n_cores, rule GS-CROSS-CORE of shared objects that several cores link; cores: variant, core, as one core may have several variants."""
    return ids.where("shared").join(F.broadcast(cores), "variant").groupBy("combined_id").agg(F.count_distinct("core").alias("n_cores")).where("n_cores > 1").withColumn("rule", F.lit("GS-CROSS-CORE"))
