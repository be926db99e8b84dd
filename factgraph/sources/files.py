"""Fact tables from and to files."""

from __future__ import annotations

import contextlib
import os
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators.multicore import elf_symbols


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Facts from JSON lines; a row that does not parse raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_compile_database(spark: SparkSession, path: str) -> DataFrame:
    """tu, entry (JSON) of a compile database, which is one JSON array; an empty one raises."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.posexplode(F.from_json("value", "array<map<string,string>>"))).select(F.col("pos").alias("tu"), F.to_json("col").alias("entry"))
    if items.isEmpty():
        raise ValueError(f"{path}: no entries")
    return items


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines beside the path first; only when all are written they take the place of what was there."""
    spark = df.sparkSession
    of = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.option("ignoreNullFields", "false").json(new)
        there = fs.exists(of(path))
        if there and not fs.rename(of(path), of(old)) or not fs.rename(of(new), of(path)):
            raise OSError(f"{path} cannot be replaced")
        if there:
            fs.delete(of(old), True)
    except Exception:
        fs.delete(of(new), True)
        if not fs.exists(of(path)) and fs.exists(of(old)):
            fs.rename(of(old), of(path))
        raise


#: A compile database's name, and folders that hold no project of their own.
DATABASE, PRUNED = "compile_commands.json", ("node_modules", "__pycache__")


def list_files(spark: SparkSession, root: str, names: list[str], pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """path, file (below root), size of the files whose name fits one of the globs. Folders with a pruned name or a leading point are left out; no file's content is read."""
    glob = "{" + ",".join(names) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = F.substring(plain, F.lit(len(top.replace("file:", "", 1)) + 2), F.length("path"))
    folders = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    rows = found.withColumn("file", below)
    return rows.where(~F.exists(folders, lambda f: f.isin(list(pruned)) | F.startswith(f, F.lit(".")))).select("path", "file", "size")


def discover_database(spark: SparkSession, root: str) -> str:
    """Path of the project's compile database: the only one below root; none or several raise, and several are named."""
    found = sorted(r.path for r in list_files(spark, root, [DATABASE]).limit(100).collect())
    if len(found) != 1:
        raise ValueError(f"{root}: no {DATABASE}" if not found else f"{root}: several compile databases, name one: {', '.join(found)}")
    return found[0]


def scan_images(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """path, ord, name, address, size, binding, type, defined: symbols of all ELF images below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names or ["*.elf", "*.axf", "*.out"]) + "}").option("recursiveFileLookup", "true").load(root)
    return elf_symbols(files.select("path", "content"))


def flat(df: DataFrame) -> DataFrame:
    """Columns by name, nested ones as JSON text: the shape of the SQLite tables."""
    nested = lambda t: isinstance(t, (T.ArrayType, T.StructType, T.MapType))
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if nested(f.dataType) else F.col(f.name) for f in sorted(df.schema, key=lambda f: f.name)])


def write_sqlite(tables: dict[str, DataFrame], path: str, at_once: int = 10_000) -> None:
    """One table for each DataFrame in a new database that replaces path when complete; rows stream through the driver, `at_once` held."""
    temp = f"{path}.{os.getpid()}.tmp"
    try:
        with contextlib.closing(sqlite3.connect(temp)) as con:
            _fill(con, tables, at_once)
        os.replace(temp, path)
    except Exception:
        with contextlib.suppress(FileNotFoundError):
            os.remove(temp)
        raise


def _fill(con: sqlite3.Connection, tables: dict[str, DataFrame], at_once: int) -> None:
    for name, df in tables.items():
        df = flat(df)
        con.execute(f'CREATE TABLE "{name}" ({", ".join(f"""\"{c}\"""" for c in df.columns) or "empty"})')
        batch: list[tuple] = []
        insert = lambda name=name, df=df, batch=batch: con.executemany(f'INSERT INTO "{name}" VALUES ({",".join("?" * len(df.columns))})', batch)
        for row in df.toLocalIterator():
            batch.append(tuple(row))
            if len(batch) >= at_once:
                insert()
                batch.clear()
        if batch:
            insert()
        for c in ("symbol_id", "function_id"):
            if name == "accesses" and c in df.columns:
                con.execute(f'CREATE INDEX "access_{c}" ON accesses({c})')
    con.commit()
