"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 8192, 8192


def add_slices(groups: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps by weight: three of one weight become one and a carry, until each weight has one."""
    out, w = [], 0
    while groups:
        own = groups.pop(w, [])
        level = np.concatenate([a if a.ndim == 2 else a[None] for a in own]) if own else None
        while level is not None and len(level) > 1:
            n = max(1, len(level) // 3)
            a, b = level[:n], level[n : 2 * n]
            c = level[2 * n : 3 * n] if len(level) >= 3 else np.zeros_like(a)
            half = a ^ b
            groups.setdefault(w + 1, []).append(a & b | half & c)
            level = np.concatenate([half ^ c, level[3 * n :]])
        out.append(level[0] if level is not None else None)
        w += 1
    return out


def highest(slices: list[np.ndarray], among: np.ndarray, k: int, n_rows: int) -> np.ndarray:
    """Places of the k largest sums, ties to the smaller place: from the top slice down, rows are sure, tied or out."""
    sure, tied = np.zeros_like(among), among.copy()
    for s in reversed(slices):
        on = tied & s if s is not None else np.zeros_like(tied)
        n = int(np.bitwise_count(sure | on).sum())
        if n > k:
            tied = on
        else:
            sure, tied = sure | on, tied & ~on
            if n == k:
                tied = np.zeros_like(tied)
                break
    bits = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")[:n_rows])
    found = bits(sure)
    return np.concatenate([found, bits(tied)[: k - len(found)]])


class Slices:
    """Rows' attributes as bitmaps by bit, all shifted to be non-negative."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.rows, self.n = rows, len(rows)
        self.low = rows.min(axis=0)
        shifted = (rows - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        pad = -self.n % 64
        planes = (shifted.T[:, None, :] >> np.arange(self.bits, dtype=np.uint64)[None, :, None] & np.uint64(1)).astype(np.uint8)
        self.maps = np.ascontiguousarray(np.packbits(np.pad(planes, ((0, 0), (0, 0), (0, pad))), axis=2, bitorder="little")).view(np.uint64)
        self.all = np.packbits(np.pad(np.ones(self.n, np.uint8), (0, pad)), bitorder="little").view(np.uint64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For a negative weight the complement of each slice is added; the constant that this adds is the same for all rows."""
        groups: dict[int, list[np.ndarray]] = {}
        size = np.abs(query)
        if len(query) * int(size.max()) * max(abs(int(self.rows.max())), abs(int(self.low.min()))) >= 1 << 62:
            raise OverflowError("components are too large for a 64-bit inner product")
        for c in range(int(size.max()).bit_length() if len(size) else 0):
            for sign in (query > 0, query < 0):
                use = sign & (size >> c & 1).astype(bool)
                if use.any():
                    for b in range(self.bits):
                        m = self.maps[use, b]
                        groups.setdefault(b + c, []).append(m if query[use][0] > 0 else ~m)
        among = self.all
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        if b > a:
            among = among.copy()
            for i in range(a, b):
                among[i // 64] &= ~np.uint64(1 << (i % 64))
        at = highest(add_slices(groups), among, k, self.n)
        return self.ids[at], self.rows[at] @ query


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query (vec_id divisible by every).

    Components become floor(scale * x); vectors that are null or hold null or
    non-finite components take no part, nor do rows of another dimension than
    the query's, nor rows that share the query's vec_id. Repeated queries count
    once, repeated candidates each. Ties go to the smaller vec_id.

    Components so large that an inner product may leave 64 bits raise an error.
    Other columns are left out; an empty table gives no rows.

    Blocks of about ROW_BLOCK rows meet blocks of about QUERY_BLOCK queries in
    one job, each pair of blocks in a task, which returns k rows a query.
    """
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0)).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("v"))
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])

    def search(rows, queries):
        own: list[tuple] = []
        sizes = rows.v.map(len)
        for size in sizes.unique():
            part = rows[sizes == size]
            index = Slices(part.vec_id.to_numpy(np.int64), np.stack(part.v.to_list()).astype(np.int64))
            own += [(q, *index.search(np.array(v, np.int64), q, k)) for q, v in zip(queries.vec_id, queries.v, strict=True) if len(v) == size]
        if not own:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return pd.DataFrame({"query_id": np.repeat([q for q, *_ in own], [len(a) for _, a, _ in own]), "vec_id": np.concatenate([a for _, a, _ in own]), "score": np.concatenate([s for *_, s in own])})

    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("row_block", F.pmod(F.monotonically_increasing_id(), F.lit(row_blocks)).cast("int")).withColumn("query_block", every_block(query_blocks))
    right = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("row_block", every_block(row_blocks))
    found = left.groupBy("row_block", "query_block").cogroup(right.groupBy("row_block", "query_block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
