"""Exact Jaccard join of word-shingle sets in size-banded tiles with bitmap signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_parts, lean, stored

BUCKETS, CHUNK, BROADCAST_IDS = 1 << 20, 1 << 14, 1_000_000
#: Rows that meet in one task, about: of all tiles of a cell, and of one block of a hot tile.
CELL_ROWS, BLOCK_ROWS, PAIRS_AT_ONCE = 50_000, 8192, 1 << 19
#: Partners that a row tries first, as rows before it in its tile, beside the tile's smallest doc_id; of all these it takes the PARTNERS with which it shares most tiles.
OFFERS, PARTNERS, CLASSES = (1, 2, 3, 5, 8, 13), 3, 6
#: Partners of a row that a cell names for the second try, of which those ALIKE are taken whose signatures are most alike.
NEAREST, ALIKE = 6, 24
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    return h ^ (h >> np.uint64(29))


# The hash of a word is a polynomial of its bytes' random numbers, in wrapping 64-bit arithmetic.
BASE, CHUNK_BYTES = 0x9E3779B97F4A7C13, 1 << 19
POWERS = [np.cumprod(np.full(1 << 12, x, np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64))]
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse to the 1st, 2nd, ... nth at least; kept by the worker, as long as its longest chunk."""
    while len(POWERS[0]) < n:
        POWERS[:] = [np.concatenate([p, p * p[-1]]) for p in POWERS]
    return POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data; A-Z count as a-z, white space is ASCII only."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACES[raw]
    turns = np.flatnonzero(np.diff(inside))
    start, end = turns[::2], turns[1::2]
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def chunks(texts):
    """Lists of texts as bytes, about CHUNK_BYTES at a time; a longer text is one of its own."""
    some, size = [], 0
    for t in texts:
        t = t.encode() if t else b""
        if some and size + len(t) > CHUNK_BYTES:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield some


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; fewer words make one."""
    out = []
    for some in chunks(texts):
        h, start = word_hashes(b"\n".join(some))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in some]))
        full = np.full(max(0, len(h) - k + 1), k, np.uint64)
        for j in range(k):
            full = mix(full * ODD[0] + h[j : j + len(full)] * ODD[1] + ODD[2])
        first = 0
        for last in ends.tolist():
            s = full[first : last - k + 1] if last - first >= k else _short(h[first:last])
            s = np.sort(s)
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            first = last
    return out


def _short(h: np.ndarray) -> np.ndarray:
    """The one shingle of fewer words than a shingle has; none of no words."""
    out = np.full(min(1, len(h)), len(h), np.uint64)
    for j in range(len(h)):
        out = mix(out * ODD[0] + h[j : j + 1] * ODD[1] + ODD[2])
    return out


def signature(s: np.ndarray) -> bytes:
    """A bitmap of half of the set, about as wide as the set; both halves of a wider one together give the next narrower one."""
    width = max(64, 1 << (len(s).bit_length() - 1) if len(s) else 0)
    bits = np.zeros(width, np.uint8)
    bits[(s[s >> np.uint64(63) == 0] & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def summaries(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for pdf in byte_parts(batches):
            sets = shingle_sets(pdf.text, k)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sig": [signature(s) for s in sets]})

    return docs.mapInPandas(lean(run), "doc_id long, n long, key binary, sig binary")


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Class of each of BUCKETS hash buckets by the shingles in it: an order of fixed size in which frequent shingles come late."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for pdf in byte_parts(batches):
            for s in shingle_sets(pdf.text, k):
                np.add.at(total, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        yield pd.DataFrame({"chunk": np.arange(BUCKETS // CHUNK), "n": [x.tobytes() for x in total.reshape(-1, CHUNK)]})

    def add(key, pdf):
        total = sum(np.frombuffer(x, np.int64) for x in pdf.n)
        return pd.DataFrame({"chunk": [key[0]], "class": [np.minimum(np.log2(total + 1.0) * CLASSES, 255).astype(np.uint8).tobytes()]})

    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint8)
    for r in docs.mapInPandas(lean(run), "chunk int, n binary").groupBy("chunk").applyInPandas(add, "chunk int, class binary").collect():
        out[r["chunk"]] = np.frombuffer(r["class"], np.uint8)
    return out.ravel()


def tile_rows(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """A row for each prefix shingle of a set: two linked sets share one, as they differ in few. blocks: into how many its tile is to be split, by its bucket's class."""
    def run(batches):
        for pdf in byte_parts(batches):
            parts = []
            for doc, s in zip(pdf.doc_id, shingle_sets(pdf.text, k), strict=True):
                n = len(s)
                if not n:
                    continue
                own = classes.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                m = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, own))[:m]
                some = s[s >> np.uint64(61) == 0] & np.uint64(127)
                sig = np.zeros(128, np.uint8)
                sig[some.astype(np.int64)] = 1
                sig = np.packbits(sig, bitorder="little").view(np.int64)
                blocks = np.ceil(2.0 ** (own[order] / CLASSES) / BLOCK_ROWS).astype(np.int64)
                parts.append((s[order].view(np.int64), np.full(m, doc), np.full(m, n), np.arange(m), np.full(m, sig[0]), np.full(m, sig[1]), blocks))
            if parts:
                yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("token", "doc_id", "n", "pos", "s0", "s1", "blocks"), zip(*parts, strict=True), strict=True)})

    return docs.mapInPandas(lean(run), "token long, doc_id long, n int, pos int, s0 long, s1 long, blocks int")


class Tile:
    """Rows of some tiles, by token, size and doc_id."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf[pdf.token.duplicated(keep=False)].sort_values(["token", "n", "doc_id"], ignore_index=True)
        self.token, self.n, self.pos, self.doc = (pdf[c].to_numpy(np.int64) for c in ("token", "n", "pos", "doc_id"))
        self.s0, self.s1 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("s0", "s1"))
        self.starts = np.flatnonzero(np.r_[True, self.token[1:] != self.token[:-1]]) if len(pdf) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[self.starts, len(pdf)])
        self.pdf = pdf

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of places pass the bounds of size, place and bitmap."""
        n, s0, s1 = self.n, self.s0, self.s1
        ok = (self.token[i] == self.token[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (self.doc[i] != self.doc[j])
        i, j = i[ok], j[ok]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        out_i = np.bitwise_count(s0[i] & ~s0[j]).astype(np.int64) + np.bitwise_count(s1[i] & ~s1[j])
        out_j = np.bitwise_count(s0[j] & ~s0[i]).astype(np.int64) + np.bitwise_count(s1[j] & ~s1[i])
        ok[ok] = (np.minimum(n[i] - self.pos[i], n[j] - self.pos[j]) >= need) & (n[i] - out_i >= need) & (n[j] - out_j >= need)
        return ok

    def nearest(self, i: np.ndarray, j: np.ndarray, n: int) -> pd.DataFrame:
        """a, b, far: for each row of i those n of its partners whose bitmaps differ in the fewest bits."""
        far = np.bitwise_count(self.s0[i] ^ self.s0[j]).astype(np.int64) + np.bitwise_count(self.s1[i] ^ self.s1[j])
        both = pd.DataFrame({"a": self.doc[i], "b": self.doc[j], "far": far}).drop_duplicates(["a", "b"])
        return both.sort_values(["far", "b"]).groupby("a", sort=False).head(n)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        both = pd.DataFrame({"a": np.minimum(self.doc[i], self.doc[j]), "b": np.maximum(self.doc[i], self.doc[j])})
        return both.groupby(["a", "b"], sort=False).size().reset_index(name="tiles") if len(both) else both.assign(tiles=0)


def cells(rows: DataFrame, n_rows: int, *salt):
    """Rows grouped into cells of whole tiles, or of whole blocks of tiles; the grouping is the planner's to keep."""
    return rows.groupBy(F.pmod(F.xxhash64("token", *salt), F.lit(max(1, n_rows // CELL_ROWS))).alias("cell"))


def offers(rows: DataFrame, n_rows: int, percent: int) -> DataFrame:
    """a, b: for each b the PARTNERS smaller doc_ids, among a few rows of each of its tiles, that share most tiles with it. Hot tiles are split at random."""
    def run(pdf):
        t = Tile(pdf)
        every = np.arange(len(t.doc))
        i, j = [], []
        for step in OFFERS:
            i.append(every[step:])
            j.append(every[: len(every) - step])
        if len(every):
            first = np.array([s + int(t.doc[s : s + n].argmin()) for s, n in zip(t.starts.tolist(), t.sizes.tolist(), strict=True)])
            i.append(every)
            j.append(np.repeat(first, t.sizes))
        i, j = np.concatenate(i), np.concatenate(j)
        ok = t.may_link(i, j, percent)
        return t.pairs(i[ok], j[ok])

    split = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    found = cells(rows, n_rows, split).applyInPandas(run, "a long, b long, tiles long").groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("tiles"), "a"))
    return found.withColumn("nth", nth).where(F.col("nth") <= PARTNERS).select("a", "b")


def closest(rows: DataFrame, n_rows: int, every: DataFrame, percent: int) -> DataFrame:
    """a, b: for each row outside its tiles' main components the ALIKE ones of other components whose signatures are most alike, of those in its tiles whose bitmaps are."""
    found = bounded(between(rows, n_rows, percent, NEAREST).select("a", "b").distinct(), every, percent)
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("alike"), "b"))
    return found.withColumn("nth", nth).where(F.col("nth") <= ALIKE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def between(rows: DataFrame, n_rows: int, percent: int, nearest: int = 0) -> DataFrame:
    """a, b: all pairs of rows of different components of a tile that pass the bounds; or, with nearest, a, b, far: so many of each row (a) and cell, those with the most similar bitmaps.

    Such a pair has at least one row outside the tile's main component, so only
    these rows look for partners. A hot tile is split into blocks: each row has
    one block as its own, and those that look for partners go to all blocks.
    """
    def run(pdf):
        t = Tile(pdf)
        if not len(t.doc):
            return t.nearest(t.doc, t.doc, 1) if nearest else t.pairs(t.doc, t.doc)
        comp, own = t.pdf.comp.to_numpy(np.int64), t.pdf.own.to_numpy(bool)
        tile = np.repeat(np.arange(len(t.starts)), t.sizes)
        main = t.pdf.main.fillna(0).to_numpy(np.int64)
        looks = comp != np.where(t.pdf.known.to_numpy(bool), main, largest(tile, comp)[tile])
        i, key = np.flatnonzero(looks), tile << 32 | t.n
        lo = np.searchsorted(key, tile[i] << 32 | -(-t.n[i] * percent // 100))
        hi = np.searchsorted(key, tile[i] << 32 | t.n[i] * 100 // percent, "right")
        edge, at, found = np.r_[0, np.cumsum(hi - lo)], 0, [t.nearest(i[:0], i[:0], 1) if nearest else t.pairs(i[:0], i[:0])]
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(edge, edge[at] + PAIRS_AT_ONCE, "right")) - 1)
            count = (hi - lo)[at:to]
            x = np.repeat(i[at:to], count)
            y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at:to], count)
            keep = own[y] & (comp[x] != comp[y]) & (~looks[y] | (x < y) | ~own[x])
            x, y = x[keep], y[keep]
            ok = t.may_link(x, y, percent)
            x, y = x[ok], y[ok]
            found.append(t.nearest(np.r_[x, y[looks[y]]], np.r_[y, x[looks[y]]], nearest) if nearest else t.pairs(x, y))
            at = to
        if nearest:
            return pd.concat(found).drop_duplicates(["a", "b"]).sort_values(["far", "b"]).groupby("a", sort=False).head(nearest)
        return pd.concat(found).groupby(["a", "b"], sort=False, as_index=False).sum()

    alone = rows.where("blocks = 1").withColumns({"main": F.lit(0).cast("long"), "known": F.lit(False), "block": F.lit(0), "own": F.lit(True)})
    hot = rows.where("blocks > 1")
    sizes = hot.groupBy("token", "comp").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("comp", "m").alias("main"), F.sum("m").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    sizes = sizes.select("token", "main", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("parts"))
    hot = hot.join(sizes, "token").withColumn("known", F.lit(True)).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    all_blocks = F.when(F.col("comp") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    hot = hot.withColumn("block", F.explode(all_blocks)).withColumn("own", F.col("block") == F.col("home"))
    both = alone.unionByName(hot.drop("parts", "home"))
    found = cells(both, n_rows, "block").applyInPandas(run, f"a long, b long, {'far' if nearest else 'tiles'} long")
    return found if nearest else found.select("a", "b").distinct()


def largest(tile: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """The most frequent component of each tile."""
    order = np.lexsort((comp, tile))
    tile, comp = tile[order], comp[order]
    head = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (comp[1:] != comp[:-1])])
    n = np.diff(np.r_[head, len(tile)])
    by_size = np.lexsort((n, tile[head]))
    out = np.zeros(int(tile[-1]) + 1, np.int64)
    out[tile[head][by_size]] = comp[head][by_size]  # the last of a tile stays
    return out


def bounded(pairs: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures leave room for the link: a document's bits that the other lacks bound the overlap from above. alike: the share of their bits that both have."""
    def run(batches):
        for pdf in batches:
            keep, alike = [], []
            for sa, sb, na, nb in zip(pdf.sig_a, pdf.sig_b, pdf.n_a, pdf.n_b, strict=True):
                a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                while len(a) > len(b):
                    a = a[: len(a) // 2] | a[len(a) // 2 :]
                while len(b) > len(a):
                    b = b[: len(b) // 2] | b[len(b) // 2 :]
                need = -(-percent * (na + nb) // (100 + percent))
                keep.append(na - int(np.bitwise_count(a & ~b).sum()) >= need and nb - int(np.bitwise_count(b & ~a).sum()) >= need)
                alike.append(int(np.bitwise_count(a & b).sum()) / max(1, int(np.bitwise_count(a | b).sum())))
            yield pdf[["a", "b"]].assign(alike=alike)[np.array(keep, bool)]

    side = lambda x: every.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(lean(run), "a long, b long, alike double")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sorted sets really overlap enough."""
    pairs = stored(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(shingle_sets(pdf.ta, k), shingle_sets(pdf.tb, k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, comp (smallest doc_id) by alternating large and small stars; the work table is small beside the documents."""
    def star(e, large: bool):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        x = both.join(low, "u")
        x = x.where("v > u") if large else x.where("v <= u")
        moved = x.select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            moved = moved.union(low.select(F.col("m"), F.col("u")))
        return moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    state = None
    while True:
        # Each star is written: one within the other would plan the inner one once for every place it is read.
        edges = stored(star(stored(star(edges, True)), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("comp"))
        state = now


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Sets link when 100 * intersection >= percent * union. Equal sets count once,
    under their smallest doc_id. Null texts and texts without words are linked
    with nothing. Rows that repeat a doc_id are joined to one component by it,
    and each gives a row. Other columns are left out; an empty table gives none.

    First every set tries a few partners that pass the bounds, and sets outside
    their tiles' main components those that look most alike; then, in
    tiles that still hold several components, all pairs between these are
    verified, so no link is lost while a group of near copies is not spelled out
    in pairs.
    Candidates meet signatures of some bits a shingle first, and whole texts
    only where these leave room for a link.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stored(summaries(docs, k))
    # Sets without shingles stay alone.
    first = every.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    member = stored(every.join(first, "key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")))
    copies = member.where("doc_id != rep").select("doc_id")
    single = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    classes = spark.sparkContext.broadcast(frequencies(single, k))
    rows = stored(tile_rows(single, k, percent, classes))
    n_rows = rows.count()
    links = stored(verify(bounded(offers(rows, n_rows, percent), every, percent), single, k, percent))
    labelled = _labelled(rows, stored(components(links)))
    links = stored(links.union(verify(closest(labelled, n_rows, every, percent), single, k, percent)))
    labelled = _labelled(rows, stored(components(links)))
    more = stored(verify(bounded(between(labelled, n_rows, percent), every, percent), single, k, percent))
    comp = stored(components(links.union(more)))
    return member.join(comp.withColumnRenamed("doc_id", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(comp) if comp.count() <= BROADCAST_IDS else comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with exactly one row of each component: one of its smallest doc_id, null being the largest.

    Rows have a key of their own here, so that repeated rows are copies of each other and null doc_ids count as rows.
    """
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()))
    found = join(docs.select(F.col("row").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = docs.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return docs.join(kept, "row", "left_semi").drop("row")
