"""Exact removal of byte strings that an earlier document has: interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored

MIN_BYTES, ROUND_BYTES, CHUNK_BYTES, HELD_ROWS = 50, 1 << 20, 1 << 18, 120_000
LAST = (1 << 63) - 1  # stands for a null doc_id
MULT = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes."""
    h = (a * MULT ^ b) * MULT
    return h ^ (h >> np.uint64(29))


def window_hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, ... 32 bytes from each place on."""
    out = {1: BYTE[data]}
    for k in (1, 2, 4, 8, 16):
        h = out[k]
        out[2 * k] = both(h[:-k], h[k:])
    return out


def segments(texts: list[bytes], size: int = MIN_BYTES):
    """Runs of size-byte strings that have the same smallest anchor (a hash of 20 bytes), at most size - 19 strings each.

    Arrays: number of the text, anchor, hash of the run's bytes, first place, number of strings.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    w = size - 19
    if len(data) < size:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    hashes = window_hashes(data)
    low = both(hashes[16][: len(data) - 19], hashes[4][16 : len(data) - 3])
    step, left = 1, w - 1
    while left:  # minimum over w places by doubling
        more = min(step, left)
        low = np.minimum(low[: len(low) - more], low[more:])
        step, left = step + more, left - more
    ends = np.cumsum(lens)
    own = np.repeat(np.arange(len(texts)), np.maximum(lens - size + 1, 0))
    starts = np.cumsum(np.maximum(lens - size + 1, 0))
    if not len(own):
        return segments([], size)
    first = np.arange(len(own)) - np.r_[0, starts[:-1]][own]
    at = first + (ends - lens)[own]
    low = low[at]
    head = np.r_[True, (low[1:] != low[:-1]) | (own[1:] != own[:-1])]
    heads = np.flatnonzero(head)
    since = np.arange(len(own)) - np.repeat(heads, np.diff(np.r_[heads, len(own)]))
    heads = np.flatnonzero(since % w == 0)
    n = np.diff(np.r_[heads, len(own)])
    # Windows of 32 bytes side by side, the last one at the end, cover the whole segment.
    a, last, h32 = at[heads], n + size - 1 - 32, hashes[32]
    seg = both(h32[a + last], n.astype(np.uint64))
    for offset in range(0, 2 * size - 52, 32):
        seg = both(seg, h32[a + np.minimum(offset, last)])
    return own[heads], low[heads], seg, first[heads], n


def common_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and the class of equal prefixes of `least` symbols; the last of the symbols, 0, is there once.

    Backward extension from the empty string, breadth first: all intervals of
    one length are extended by every symbol at once; a border found in round l
    is a common prefix of l - 1. Rounds end at `least`.
    """
    n, step = len(text), 7
    rank = np.zeros(n, np.int64)
    for j in range(step):  # symbols of 9 bits
        rank[: n - j] |= text[j:].astype(np.int64) << 9 * (step - 1 - j)
    rank = np.unique(rank, return_inverse=True)[1]
    while step < least and rank.max() < n - 1:  # order by the first `least` symbols, which is all that the classes need
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    bwt = text[order - 1]  # the symbol before each suffix; the first suffix wraps round
    back = np.argsort(bwt, kind="stable").astype(np.int32)  # row of the suffix that is one symbol shorter
    other = np.r_[True, np.diff(bwt[back]) != 0]
    border = np.zeros(n, bool)
    border[0] = True
    for _ in range(least):
        c = np.cumsum(border, dtype=np.int32)[back]
        border |= other
        border[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(border) - 1


def owned_runs(parts: list[bytes], owners: np.ndarray, size: int):
    """Runs of strings of `size` bytes that a part with a smaller owner holds: number of the part, first place, bytes."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    part = np.repeat(np.arange(len(parts)), lens + 1)
    place = np.arange(len(part)) - np.repeat(np.cumsum(lens + 1) - lens - 1, lens + 1)
    text = np.full(len(part), 257, np.int16)  # bytes are 1 to 256, 257 ends a part
    text[place < lens[part]] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    text[-1] = 0
    order, cls = common_prefixes(text, size)
    owner = owners[part]
    least = np.minimum.reduceat(owner[order], np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]))
    on = np.empty(len(text), bool)
    on[order] = least[cls] < owner[order]
    edge = np.diff(np.r_[0, (on & (place + size <= lens[part])).view(np.int8), 0])
    a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return part[a], place[a], b - a + size - 1


def rows_of(docs: DataFrame, size: int) -> DataFrame:
    """key, seg, doc_id, th, start, n, done: the segments of every text, by anchor; th is the hash of the text.

    Of a segment that several documents of a batch hold, only the first document's rows stay open; the
    others are repeats for sure (done) and are dealt by document, so that no anchor gathers them.
    """
    def run(batches):
        def flush():
            doc, th, key, seg, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, seg, key))
            k, s, d = key[order], seg[order], doc[order]
            head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            later = np.empty(len(doc), bool)
            later[order] = d != np.repeat(d[head], np.diff(np.r_[head, len(d)]))
            key = np.where(later, doc * 0x9E3779B1, key.view(np.int64))
            return pd.DataFrame({"key": key, "seg": np.where(later, 0, seg.view(np.int64)), "doc_id": doc, "th": th, "start": start, "n": n, "done": later})

        held, count = [], 0
        for pdf in batches:
            docs_, ths, texts = pdf.doc_id.to_numpy(), pdf.th.to_numpy(), [t.encode() for t in pdf.text]
            edge = np.r_[0, np.cumsum([len(t) for t in texts])] // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(edge[:-1])) + 1).tolist(), len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                own, key, seg, start, n = segments(texts[i:j], size)
                held.append((docs_[i:j][own], ths[i:j][own], key, seg, start, n))
                count += len(own)
                if count >= HELD_ROWS:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return docs.mapInPandas(lean(run), "key long, seg long, doc_id long, th long, start long, n int, done boolean")


def in_order(rows: DataFrame, key: str, work, schema: str) -> DataFrame:
    """work(rows whose keys are complete, rows of the one that may go on): its rows and what to hold of the latter."""
    def run(batches):
        held, count = [], 0
        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            if count * 80 >= ROUND_BYTES:
                t = pd.concat(held, ignore_index=True)
                last = (t[key] == t[key].iat[-1]).to_numpy()
                out, rest = work(t[~last], t[last])
                yield from out
                held, count = [rest], 0
        if held:
            t = pd.concat(held, ignore_index=True)
            yield from work(t, t[:0])[0]

    return rows.repartition(key).sortWithinPartitions(key, "doc_id").mapInPandas(lean(run), schema)


def open_segments(rows: DataFrame, size: int) -> DataFrame:
    """key, doc_id, th, start, n, done: repeats of whole segments (done), and rows of anchors with several segments, whose bytes decide."""
    columns = ["key", "doc_id", "th", "start", "n", "done"]

    def settle(t):
        """Equal segments belong to their first document; the others are done."""
        first = t.groupby(["key", "seg"], sort=False).doc_id.transform("min").to_numpy()
        return t.assign(done=t.done | (first < t.doc_id.to_numpy()))

    def work(t, rest):
        out = [t.loc[t.done, columns]]
        t = t[~t.done]
        t = t[t.key.duplicated(keep=False)]
        if len(t):
            t = settle(t)
            own = t[~t.done]
            several = own.groupby("key", sort=False).seg.transform("nunique") > 1
            out += [t.loc[t.done, columns], own.loc[several, columns]]
        if len(rest):
            out.append(rest.loc[rest.done, columns])
            rest = settle(rest[~rest.done])
            out.append(rest.loc[rest.done, columns])
            rest = rest[~rest.done]
        return out, rest

    return in_order(rows, "key", work, "key long, doc_id long, th long, start long, n int, done boolean")


def compared(segs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, start, len of strings that an earlier document's segment of the same anchor holds."""
    def search(t):
        no = t.assign(part=pd.factorize(t.bytes)[0]).groupby(["key", "part"], sort=False).ngroup().to_numpy()
        head = np.unique(no, return_index=True)[1]
        owner = t.doc_id.groupby(no).min().to_numpy()
        part, a, n = owned_runs(t.bytes.to_numpy()[head].tolist(), owner, size)
        found = pd.DataFrame({"no": no, "doc_id": t.doc_id.to_numpy(), "th": t.th.to_numpy(), "start": t.start.to_numpy()}).merge(pd.DataFrame({"no": part, "a": a, "len": n}), on="no")
        later = owner[no] < t.doc_id.to_numpy()
        whole = pd.DataFrame({"doc_id": t.doc_id[later], "th": t.th[later], "start": t.start[later], "len": t.bytes[later].map(len)})
        return pd.concat([found.assign(start=found.start + found.a)[["doc_id", "th", "start", "len"]], whole])

    def work(t, rest):
        return [search(t)] if len(t) else [], rest

    return in_order(segs, "key", work, "doc_id long, th long, start long, len long")


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, start, len of byte runs that an earlier document has."""
    found = stored(open_segments(rows_of(docs, size), size))
    wanted = found.where("not done").groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))

    def cut(batches):
        for pdf in batches:
            rows = []
            for doc, th, text, wanted in zip(pdf.doc_id, pdf.th, pdf.text, pdf.wanted, strict=True):
                raw = text.encode()
                rows += [(w["key"], doc, th, w["start"], raw[w["start"] : w["start"] + w["n"] + size - 1]) for w in wanted]
            yield pd.DataFrame([r for r in rows if len(r[4]) >= size], columns=["key", "doc_id", "th", "start", "bytes"])

    segs = docs.join(wanted, ["doc_id", "th"]).mapInPandas(lean(cut), "key long, doc_id long, th long, start long, bytes binary")
    return found.where("done").select("doc_id", "th", "start", (F.col("n") + size - 1).cast("long").alias("len")).unionByName(compared(segs, size))


def dedup(docs: DataFrame, size: int = MIN_BYTES, carry: list[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (text) of every row.

    Removes each byte of a `size`-byte string that a document with a smaller
    doc_id has too; strings are judged on the input. Null texts are empty. Rows
    that repeat a doc_id never remove from each other; each loses what an earlier
    doc_id has. Null doc_ids come after all others and count as one doc_id. In
    `kept` a character that is cut in half is dropped; kept_sha256 is of all bytes.
    size is at least 32. An empty table gives no rows.
    Other columns are left out, except strings to carry.
    """
    if size < 32:
        raise ValueError("size: 32 bytes at least")
    real, carry = F.col("doc_id").cast("long"), list(carry)
    docs = docs.select(F.coalesce(real, F.lit(LAST)).alias("doc_id"), real.isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"), *carry).withColumn("th", F.xxhash64("text"))
    # Whole copies of an earlier text need no search.
    text_key, n = F.md5("text"), F.octet_length("text")
    first = docs.groupBy(text_key.alias("k"), n.alias("len")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where(F.col("len") >= size)
    keyed = docs.select("doc_id", "th", text_key.alias("k"), n.cast("long").alias("len")).distinct()
    copies = stored(keyed.join(first.where("copies > 1").select("k", "first"), "k").where("doc_id > first").select("doc_id", "th", F.lit(0).cast("long").alias("start"), "len").distinct())
    left = docs.select("doc_id", "th", "text").join(copies.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti")
    marks = repeats(left, size).unionByName(copies).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("marks"))

    def apply(batches):
        for pdf in batches:
            rows = []
            for no_id, text, marks in zip(pdf.no_id, pdf.text, pdf.marks, strict=True):
                raw, spans, out, at = text.encode(), [], [], 0
                for m in marks if marks is not None else ():
                    a, b = int(m["start"]), int(m["start"]) + int(m["len"])
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    out.append(raw[at:a])
                    at = b
                out.append(raw[at:])
                kept = b"".join(out)
                rows.append((no_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            out = pd.DataFrame(rows, columns=["no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield out.assign(doc_id=pdf.doc_id.to_numpy(), **{c: pdf[c].to_numpy() for c in carry})

    types = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(carry).schema)
    done = docs.join(marks, ["doc_id", "th"], "left").mapInPandas(lean(apply), f"doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string{types}")
    return done.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
