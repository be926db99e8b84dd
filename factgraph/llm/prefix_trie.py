"""Prefix trie of conversations: polynomial prefix fingerprints, groups verified turn by turn, parents rolled up along paths.

A node's conv_id is its smallest member, so the nodes of one conv_id form a
downward path: from some depth to the conversation's end. Every other path
hangs on one node of it, and each conversation's own prefixes name all paths
above its own. That makes the roll-up two sums without a loop over depths:
what each path adds to each path above it, at the depth where it leaves that
one, then a sum from the end of each path upward.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

#: Two moduli below 2^31, so that products fit 63 bits, and a base for each; a fingerprint has 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Turns of another conversation that a rebuilt one may start with, at most, and the distance of those conversations.
HEAD, EVERY = 5, 100
BLOCK_BITS = 12
WORDS = ["w1", "w2", "w3", "w4"]


# ---- fingerprints

def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) mod prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.r_[out, out * pow(base, len(out), prime) % prime]
    return out[:n]


def scan(batches, primes=PRIMES):
    """Adds to sorted rows (conv_id, digest, chars) their place k within the conversation, in this task, and prefix fingerprints.

    s = sum of turn_i * base^i mod prime over the places up to k. A batch's
    sums are running sums in numpy; place and sums of an unfinished
    conversation are carried into the next batch.
    """
    part = TaskContext.get().partitionId()
    last, count, carry = None, 0, [0, 0]
    for pdf in batches:
        if not len(pdf):
            continue
        conv = pdf.conv_id.to_numpy()
        words = np.frombuffer(b"".join(pdf.digest), ">i8").reshape(-1, 4)
        first = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(conv)), 0))
        step = np.arange(len(conv)) - start + 1
        goes_on = (start == 0) & (not first[0])  # rows of the conversation that the batch before ended in
        k = step + np.where(goes_on, count, 0)
        cols = {"conv_id": conv, "part": np.full(len(conv), part, np.int32), "k": k, "chars": pdf.chars}
        for i, (prime, base) in enumerate(zip(primes, BASES, strict=True)):
            power = _powers(base, prime, len(conv) + 1)[step] * np.where(goes_on, pow(base, count, prime), 1) % prime
            run = np.r_[0, np.cumsum(words[:, i] % prime * power % prime)]
            s = (run[1:] - run[start] + np.where(goes_on, carry[i], 0)) % prime
            cols[f"s{i + 1}"] = s
            carry[i] = int(s[-1])
        for i, w in enumerate(WORDS):
            cols[w] = words[:, i].astype(np.int64)
        last, count = conv[-1], int(k[-1])
        yield pd.DataFrame(cols)


SCANNED = "conv_id long, part int, k long, chars long, s1 long, s2 long, w1 long, w2 long, w3 long, w4 long"


def fingerprints(conversations: DataFrame, primes=PRIMES) -> DataFrame:
    """Every turn's place and prefix fingerprints in its conversation: conv_id, k, chars, s1, s2, w1 to w4.

    Turns are sorted over all tasks, so a conversation of any length lies in as
    many tasks as it needs; what a task's part of it starts with is then added
    from the ends of the parts before: at most two rows for each task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    # Read again, as the sort by ranges samples its input first.
    rows = stored(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    local = stored(rows.mapInPandas(lean(lambda batches: scan(batches, primes)), SCANNED))
    bounds = sorted(tuple(r) for r in local.groupBy("part").agg(F.min("conv_id"), F.max("conv_id")).collect())
    split = sorted({hi for (_, _, hi), (_, lo, _) in zip(bounds, bounds[1:], strict=False) if hi == lo})
    if not split:
        return local.drop("part")
    spark = conversations.sparkSession
    ends = local.join(F.broadcast(spark.createDataFrame([(c,) for c in split], "conv_id long")), "conv_id").groupBy("conv_id", "part").agg(F.max_by(F.struct("k", "s1", "s2"), "k").alias("end"))
    before, offsets = {}, []
    for conv, part, end in sorted(tuple(r) for r in ends.collect()):
        k, s1, s2 = before.get(conv, (0, 0, 0))
        b1, b2 = (pow(base, k, prime) for base, prime in zip(BASES, primes, strict=True))
        offsets.append((conv, part, k, s1, s2, b1, b2))
        before[conv] = (k + end.k, (s1 + b1 * end.s1) % primes[0], (s2 + b2 * end.s2) % primes[1])
    given = spark.createDataFrame(offsets, "conv_id long, part int, k0 long, a1 long, a2 long, b1 long, b2 long")
    moved = local.join(F.broadcast(given), ["conv_id", "part"], "left").withColumn("k", F.col("k") + F.coalesce("k0", F.lit(0)))
    for i, p in enumerate(primes, 1):
        moved = moved.withColumn(f"s{i}", F.when(F.col("k0").isNull(), F.col(f"s{i}")).otherwise((F.col(f"a{i}") + F.col(f"b{i}") * F.col(f"s{i}")) % p))
    return moved.drop("part", "k0", "a1", "a2", "b1", "b2")


def rebuild(turns: DataFrame, primes=PRIMES) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, len), and their turns with prefix fingerprints (conv_id, pos, len, key, chars, w1 to w4).

    A rebuilt prefix is a prefix of the base conversation, or that one and a
    part of the own turns; its fingerprint comes from the two conversations'
    own ones, as they are sums: no turn is scanned twice.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("long")
    turns = turns.withColumn("h", h)
    own = turns.groupBy("conv_id", "h").agg(F.count("*").alias("n"), *(F.coalesce(F.max(F.when(F.col("k") == F.col("h"), F.col(s))), F.lit(0)).alias(f"{s}h") for s in ("s1", "s2")))
    heads = turns.where((F.col("conv_id") % EVERY == 0) & (F.col("k") <= HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("k", "s1", "s2", "chars", *WORDS))).alias("head"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads, "base", "left")
    convs = convs.withColumn("m", F.when(F.col("head").isNull(), 0).otherwise(F.least("h", F.size("head")))).withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    for i, (p, base) in enumerate(zip(primes, BASES, strict=True), 1):
        inverse = F.array(*(F.lit(pow(base, -d, p)) for d in range(HEAD + 1)))
        convs = convs.withColumn(f"f{i}", inverse[(F.col("h") - F.col("m")).cast("int")])
        at_m = F.when(F.col("m") == 0, 0).otherwise(F.expr(f"head[int(m) - 1].s{i}"))
        convs = convs.withColumn(f"a{i}", F.pmod(at_m - F.col(f"f{i}") * F.col(f"s{i}h") % p, F.lit(p)))
    convs = stored(convs.select("conv_id", "h", "m", "len", "a1", "a2", "f1", "f2", F.when(F.col("m") > 0, F.expr("slice(head, 1, int(m))")).alias("head")))
    key = lambda s1, s2: s1.bitwiseOR(F.shiftleft(s2, 31))
    first = convs.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", F.col("t.k").alias("pos"), "len", key(F.col("t.s1"), F.col("t.s2")).alias("key"), "t.chars", *(f"t.{w}" for w in WORDS))
    rest = turns.where("k > h").drop("h").join(convs.drop("head"), "conv_id")
    at = [(F.col(f"a{i}") + F.col(f"f{i}") * F.col(f"s{i}")) % p for i, p in enumerate(primes, 1)]
    rest = rest.select("conv_id", (F.col("k") - F.col("h") + F.col("m")).alias("pos"), "len", key(*at).alias("key"), "chars", *WORDS)
    return convs.select("conv_id", "len"), stored(first.union(rest).withColumn("split", F.lit(0).cast("long")))


# ---- groups

NODE = ["pos", "key", "split"]


def verified(turns: DataFrame, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns and their groups (pos, key, split -> rep, n, longest), each group's members equal in their turn at its depth.

    A group whose smallest and largest words of turn digests differ holds
    members that differ from its representative. They move on, with all their
    later turns, to groups of their own: `split` then tells them apart. As a
    clean group's members share the turn and, by the sum, the fingerprint
    before it, members of groups that are clean at every depth share all turns.
    """
    for salt in range(rounds):
        spread = [f(w).alias(f"{name}_{w}") for w in WORDS for name, f in (("lo", F.min), ("hi", F.max))]
        groups = stored(turns.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("len").alias("longest"), *spread))
        mixed = groups.where(reduce(lambda a, b: a | b, (F.col(f"lo_{w}") != F.col(f"hi_{w}") for w in WORDS)))
        if mixed.isEmpty():
            return turns, groups.select(*NODE, "rep", "n", "longest")
        members = turns.join(mixed.select(*NODE, "rep"), NODE)
        led = members.where("conv_id = rep").select(*NODE, *(F.col(w).alias(f"of_{w}") for w in WORDS))
        differs = reduce(lambda a, b: a | b, (F.col(w) != F.col(f"of_{w}") for w in WORDS))
        marks = members.join(led, NODE).where(differs).groupBy("conv_id").agg(F.collect_list(F.struct(F.col("pos").alias("p"), F.xxhash64(F.lit(salt), "pos", *WORDS).alias("mark"))).alias("marks"))
        above = F.filter("marks", lambda x: x.p <= F.col("pos"))
        turns = stored(turns.join(marks, "conv_id", "left").withColumn("split", F.when(F.col("marks").isNull() | (F.size(above) == 0), F.col("split")).otherwise(F.xxhash64("split", F.aggregate(above, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.mark))))).drop("marks"))
    raise ValueError(f"fingerprints still collide after {rounds} splits")


# ---- roll-up

def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending conv_ids that end at each node; ids meet in blocks of 2^12 values, and blocks stream through the digest in order."""
    blocks = rows.groupBy("rep", "pos", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        at, sha = None, None
        for pdf in batches:
            done = []
            for rep, pos, ids in zip(pdf.rep.tolist(), pdf.pos.tolist(), pdf.ids, strict=True):
                if at == (rep, pos):
                    sha.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = (rep, pos), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["rep", "pos", "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=["rep", "pos", "ends_sha256"])

    return blocks.repartition("rep", "pos").sortWithinPartitions("rep", "pos", "block").mapInPandas(run, "rep long, pos long, ends_sha256 string")


def trie(conversations: DataFrame, primes=PRIMES) -> DataFrame:
    """One row a distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id are left out. Null role and text count as empty; turns
    of equal number, and null ones, which come first, follow one another by the
    digest of role and text. Equal rows are turns of their own. Turns are equal
    if the SHA-256 of role and text are. Other columns are left out, whatever
    their names. A table without conversations gives no nodes. Texts of any
    length are digested where they are read and never shuffled.
    """
    convs, turns = rebuild(fingerprints(conversations, primes), primes)
    total = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n"), F.max("len").alias("longest")).first()
    turns, groups = verified(turns)
    root = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), "len", F.lit(0).cast("long").alias("chars"), F.lit(total.root).cast("long").alias("rep"), F.lit(total.n).alias("n"), F.lit(total.longest).cast("long").alias("longest"))
    rows = stored(turns.select("conv_id", "len", "chars", *NODE).join(groups, NODE).select("conv_id", "pos", "len", "chars", "rep", "n", "longest").union(root.select("conv_id", "pos", "len", "chars", "rep", "n", "longest")))
    saved, leaf = (F.col("n") - 1) * F.col("chars"), (F.col("longest") == F.col("pos")).cast("long")
    spans = rows.groupBy("conv_id", "rep").agg(F.min("pos").alias("from"), F.max("pos").alias("to"), F.sum(saved).alias("saved"), F.sum(leaf).alias("leaves"))
    paths = spans.where("conv_id = rep").select("conv_id", "from", "saved", "leaves")
    hung = spans.where("conv_id <> rep").select("conv_id", F.col("rep").alias("above"), "to").join(paths, "conv_id").withColumn("next", (F.col("to") + 1 == F.col("from")).cast("long"))
    none = F.lit(0).cast("long")
    nodes = rows.where("conv_id = rep").select("conv_id", F.col("pos").alias("depth"), "n", (F.col("pos") < F.col("len")).cast("long").alias("children"), leaf.alias("leaves"), saved.alias("saved"), F.lit(None).cast("long").alias("parent"))
    nodes = nodes.union(hung.select("above", "to", none, "next", "leaves", "saved", F.lit(None).cast("long")))
    nodes = nodes.union(hung.where("next = 1").select("conv_id", "from", none, none, none, none, "above"))
    nodes = stored(nodes.groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")), F.max("parent").alias("parent")).withColumn("next", F.shiftright("depth", BLOCK_BITS) + 1))
    # From the end of each path upward: within blocks of depths, and what the later blocks hold.
    blocks = nodes.groupBy("conv_id", (F.col("next") - 1).alias("next")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("next > 0")
    later = Window.partitionBy("conv_id").orderBy(F.desc("next")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select("conv_id", "next", *(F.sum(c).over(later).alias(f"later_{c}") for c in ("leaves", "saved")))
    below = Window.partitionBy("conv_id", "next").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.select("conv_id", "next", "depth", "n", "children", "parent", *(F.sum(c).over(below).alias(c) for c in ("leaves", "saved"))).join(blocks, ["conv_id", "next"], "left")
    ends = _ends(rows.where("pos = len").select("rep", "pos", "conv_id")).withColumnsRenamed({"rep": "conv_id", "pos": "depth"})
    return nodes.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        *((F.col(c) + F.coalesce(f"later_{c}", none)).alias(name) for c, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
      lambda a, b: list_reduce(range(8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
both_parts AS (
  SELECT c.conv_id, 0 AS part, t.k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
r AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS chars, list({'r': role, 't': text}) OVER w AS prefix
  FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, d, chars, prefix, min(conv_id) OVER g AS rep, count(*) OVER g AS n, max(d) OVER (PARTITION BY conv_id) AS last FROM r WINDOW g AS (PARTITION BY d, prefix)),
own AS (SELECT rep, d, any_value(n) AS n, any_value((n - 1) * chars) AS saved, (max(last) = d)::INT AS leaf,
    coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (last = d), '') AS ends FROM m GROUP BY rep, d),
below AS (SELECT m.rep, m.d, sum(o.saved) AS saved, sum(o.leaf) AS leaves FROM m JOIN own o ON m.conv_id = o.rep AND m.d <= o.d GROUP BY m.rep, m.d),
parents AS (SELECT b.conv_id, b.d, a.rep AS parent FROM m b JOIN m a ON a.conv_id = b.conv_id AND a.d = b.d - 1 WHERE b.conv_id = b.rep),
children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM parents GROUP BY parent, d)
SELECT o.rep AS conv_id, o.d AS depth, p.parent AS parent_conv_id, o.n AS n_convs, coalesce(k.n, 0) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN below b USING (rep, d) LEFT JOIN parents p ON p.conv_id = o.rep AND p.d = o.d LEFT JOIN children k ON k.parent = o.rep AND k.d = o.d
"""
