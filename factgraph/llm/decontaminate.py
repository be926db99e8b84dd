"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, stored

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20


def words(text):
    """The words of a text after A-Z are lower-cased; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SPLIT), "")


def let(value, body):
    """body of a value that is computed once a row; the optimizer may else repeat it in each lambda call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hash(hashes, i, k: int):
    """Hash of the k word hashes from place i (0-based) on."""
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """Each distinct window of the items with the ids of its items."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - (window - 1), F.lit(1))
    w = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(F.col("w"), i, window))).alias("win"))
    return w.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, spans, items, n_hit, n_items.

    A word is hit inside any occurrence of a window of an item. Every window is
    a set of shingles; as all of it must occur, its prefix is the one shingle
    that is rarest in the documents. That shingle's place bounds where the
    window starts, and the words there are compared with the whole window.

    Null or empty texts have no words and no hits; items without words are left
    out, shorter items are one window. Rows that repeat doc_id and text give one
    row. Other columns are ignored; empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    wins = windows_of(items, window).withColumn("len", F.size("win")).withColumn("k", F.least("len", F.lit(shingle)))
    n_wins, n_bytes, widths = wins.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("win", "items")))), F.sort_array(F.collect_set("k"))).first()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    if not n_wins:
        return tokens.select("doc_id", F.col("n").cast("long").alias("n_words"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items")).distinct()
    small = (lambda df: F.broadcast(df)) if (n_bytes or 0) <= BROADCAST_BYTES else (lambda df: df)
    n_blocks = bloom.blocks_for(n_wins * (window - shingle + 1))
    def hashes_of(win, k):
        return let(F.transform(win, lambda x: F.xxhash64(x)), lambda hw: F.transform(F.sequence(F.lit(0), F.size(win) - k), lambda i: shingle_hash(hw, i, k)))

    by_width = F.coalesce(*[F.when(F.col("k") == k, hashes_of(F.col("win"), k)) for k in widths])
    each = wins.select("win", "items", "len", "k", F.posexplode(by_width).alias("at", "h"))
    possible = bloom.build(each.select("h").distinct(), "h", n_blocks).scalar()

    def found(bits):
        """Places of shingles that the filter passes, with the words around them."""
        def per_width(w, hw, k):
            first = lambda i: F.greatest(i - (window - k), F.lit(0))
            hashed = lambda i: let(shingle_hash(hw, i, k), lambda h: F.when(bloom.may_contain(F.col("bits"), h, n_blocks), F.struct(h.alias("h"), i.alias("i"), F.slice(w, first(i) + 1, 2 * window).alias("near"), first(i).alias("near_at"))))
            places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
            return F.filter(F.transform(places, hashed), lambda x: x.isNotNull())

        whole = let(words(F.col("text")), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda hw: F.struct(F.size(w).alias("n"), F.concat(*[per_width(w, hw, k) for k in widths]).alias("c"))))
        return docs.withColumn("bits", bits).select("doc_id", F.xxhash64("text").alias("text_key"), whole.alias("f")).select("doc_id", "text_key", F.col("f.n").alias("n"), F.col("f.c").alias("c"))

    # Hashing all shingles costs most, so what passes is written once, for the counts and for the join.
    base = stored(found(possible))
    seen = base.select(F.explode(F.col("c.h")).alias("h")).join(small(each.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    prefix = (each.join(seen, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "at")).alias("p"), F.first("items").alias("items"), F.first("len").alias("len"), F.first("k").alias("k"))
              .where("p.df > 0").select("win", "items", "len", F.col("p.h").alias("h"), F.col("p.at").alias("at")))
    cand = base.select("doc_id", "text_key", "n", F.explode_outer("c").alias("c"))
    cand = cand.select("doc_id", "text_key", "n", F.col("c.h").alias("h"), F.col("c.i").alias("i"), F.col("c.near").alias("near"), F.col("c.near_at").alias("near_at"))
    start = F.col("i") - F.col("at")
    hit = (start >= 0) & (start + F.col("len") <= F.col("n")) & (F.slice(F.col("near"), F.greatest(start - F.col("near_at"), F.lit(0)) + 1, F.col("len")) == F.col("win"))
    joined = cand.join(small(prefix), "h", "left").select("doc_id", "text_key", "n", F.when(hit, F.struct(start.alias("start"), F.col("len"))).alias("span"), F.when(hit, F.col("items")).alias("items"))
    out = joined.groupBy("doc_id", "text_key", "n").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("hit")), lambda a: a["hit"])
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), "spans", "items", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
