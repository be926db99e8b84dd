"""Language-model scoring on an Elias-Fano n-gram trie in memory-mapped level files."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, lean, local_path, shared_dir
from .elias_fano import EliasFano, exists
from .language_id import held_out

END = b"\n"  # no word holds it
DISCOUNT, STEP = 0.75, 12 / 65535
#: Text of a shard of the n-gram levels and of one of the words, so the number of shards follows from the corpus.
LEAST_SHARDS, GRAM_BYTES, WORD_BYTES = 16, 16 << 20, 64 << 20
#: Tokens of a shard, about; a word with a quarter of them at least is spread over all shards.
SHARD_TOKENS = GRAM_BYTES // 8
PART_BYTES, HELD = 8 << 20, 1 << 21


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-12)) / STEP), 0, 65535).astype(np.uint16)


def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)


def key_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Batch:
    """Tokens of some texts as places in a list of distinct words."""

    def __init__(self, texts):
        number: dict[bytes, int] = {}
        tokens, self.sizes = [], []
        for t in texts:
            words = t.encode().lower().split() if t else []  # of bytes: ASCII letters and white space only
            tokens.append(np.array([number.setdefault(w, len(number)) for w in words] + [number.setdefault(END, len(number))], np.int64))
            self.sizes.append(len(words) + 1)
        self.tokens, self.words = np.concatenate(tokens), list(number)
        self.keys = np.fromiter(map(key_of, self.words), np.uint64, len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.nth = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)  # tokens before it in its text


def by_shard(shard: np.ndarray):
    """Each shard with the places that hold it; places of equal shards stay in order."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 and shard.min() >= 0 else shard, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        yield int(shard[at[0]]), at


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order and the sum of each one's n. A row is an n-gram's context, second and third word, 32 bits each, in one or two columns."""
    if rows.ndim == 1:
        order = np.argsort(rows)
        rows = rows[order]
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    else:
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        head = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return rows[head], np.add.reduceat(n[order], head)


class Layout:
    """Where n-grams lie. A shard's contexts are its own first words and, after these, all hot words, whose successors are dealt out."""

    def __init__(self, path: str):
        self.shards, self.vocab, self.n_all = (int(x) for x in np.load(f"{path}/shape.npy"))
        self.hot, self.hot_n = np.load(f"{path}/hot.npy")
        self.cold = -(-self.vocab // self.shards)
        self.word_bits = max(1, int(self.vocab).bit_length())
        self.packs = max(1, int(self.cold + len(self.hot)).bit_length()) + 2 * self.word_bits < 64

    def place(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and context of the pairs."""
        shard, context = first % self.shards, first // self.shards
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            hot = self.hot[at] == first
            context = np.where(hot, self.cold + at, context)
            shard = np.where(hot, ((first * 31 + second) * 0x9E3779B1 >> 7) % self.shards, shard)
        return shard, context

    def pack(self, context, second, third) -> np.ndarray:
        if self.packs:
            return context << 2 * self.word_bits | second << self.word_bits | third
        return np.stack([context << 32 | second, third], axis=1)

    def unpack(self, rows: np.ndarray):
        if self.packs:
            mask = (1 << self.word_bits) - 1
            return rows >> 2 * self.word_bits, rows >> self.word_bits & mask, rows & mask
        return rows[:, 0] >> 32, rows[:, 0] & 0xFFFFFFFF, rows[:, 1]


class Words:
    """Level 1: words in hash order with their counts, which the base score needs exactly."""

    def __init__(self, path: str, bits: int):
        self.bits, n = bits, range(1 << bits)
        self.words = [EliasFano(f"{path}/w{s}") if exists(f"{path}/w{s}") else None for s in n]
        self.counts = [mapped(f"{path}/w{s}.count.npy") if w else None for s, w in enumerate(self.words)]
        self.offset = np.concatenate([[0], np.cumsum([w.n if w else 0 for w in self.words])])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each word."""
        ids, counts, low = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), 64 - self.bits
        for s, at in by_shard((keys >> np.uint64(low)).astype(np.int64)):
            if (ef := self.words[s]) is not None:
                found = ef.find(keys[at] & np.uint64((1 << low) - 1), np.zeros(len(at)), np.full(len(at), ef.n))
                ok = found >= 0
                ids[at[ok]], counts[at[ok]] = found[ok] + self.offset[s], self.counts[s][found[ok]]
        return ids, counts


class Trie:
    """Levels 2 and 3 by shard: successors of each context and of each pair, relative to it by pointers into the level.

    A pair's place in level 2 is its context in level 3. Only pages that searches touch are read.
    """

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout, self.opened = path, layout, {}
        self.hot_back = np.load(f"{path}/hot_back.npy")

    def level(self, k: int, s: int):
        """Pointers, successors, back-off weights and probabilities of a shard; None if it has none."""
        if (k, s) not in self.opened:
            at = f"{self.path}/l{k}.{s}"
            self.opened[k, s] = (EliasFano(f"{at}.pointer"), EliasFano(f"{at}.next"), mapped(f"{at}.back.npy"), mapped(f"{at}.prob.npy")) if os.path.exists(f"{at}.prob.npy") else None
        return self.opened[k, s]

    def follow(self, k: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Discounted probability of word after the context of a shard (-1: unknown), the weight left for the lower order, the place found or -1."""
        p, back, place = np.zeros(len(word)), np.ones(len(word)), np.full(len(word), -1, np.int64)
        for s, at in by_shard(np.where(context >= 0, shard, self.layout.shards)):
            if s == self.layout.shards or self.level(k, s) is None:
                continue
            pointer, nxt, backs, probs = self.level(k, s)
            back[at] = 10 ** (-STEP * backs[context[at]])
            at = at[word[at] >= 0]
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                c = context[part]
                found = nxt.find(c * self.layout.vocab + word[part], pointer.get(c).view(np.int64), pointer.get(c + 1).view(np.int64))
                hit = found >= 0
                place[part] = found
                p[part[hit]] = 10 ** (-STEP * probs[found[hit]])
        return p, back, place

    def follow_pairs(self, first: np.ndarray, second: np.ndarray):
        """follow() of words after words, by number, with the shard of each."""
        shard, context = self.layout.place(first, second)
        p, back, place = self.follow(2, shard, np.where(first >= 0, context, -1), second)
        hot = (context >= self.layout.cold) & (first >= 0)
        back[hot] = self.hot_back[context[hot] - self.layout.cold]
        return shard, p, back, place


def save(path: str, name: str, write) -> None:
    """Files of a task under a name of its own, then renamed, so a repeated task leaves the same files."""
    own = f"{path}/.{os.getpid()}-{os.urandom(6).hex()}"
    os.makedirs(own, exist_ok=True)
    write(own)
    for f in sorted(os.listdir(own), key=lambda f: f.endswith("prob.npy")):
        os.replace(f"{own}/{f}", f"{path}/{f}")
    os.rmdir(own)


def write_shard(path: str, layout: Layout, s: int, rows: np.ndarray, n: np.ndarray, discount: float) -> dict:
    """Levels 2 and 3 of a shard from its n-grams; returns the distinct successors of hot words."""
    context, second, third = layout.unpack(rows)
    head = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (second[1:] != second[:-1])])
    pair_n, n_contexts = np.add.reduceat(n, head), layout.cold + len(layout.hot)
    pair_context, pair_word = context[head], second[head]
    in_pair = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(context)]))
    goes_on = third < layout.vocab
    in_pair, third, n = in_pair[goes_on], third[goes_on], n[goes_on]
    total = np.bincount(pair_context, pair_n, n_contexts)
    total[layout.cold :] = layout.hot_n

    def level(own: str, k: int, context, word, n, total):
        share = (n - discount) / total[context]
        seen = np.bincount(context, minlength=len(total))
        EliasFano.write(f"{own}/l{k}.{s}.pointer", np.r_[0, np.cumsum(seen)])
        EliasFano.write(f"{own}/l{k}.{s}.next", context * layout.vocab + word)
        np.save(f"{own}/l{k}.{s}.back.npy", quantise(np.where(seen > 0, discount * seen / np.maximum(total, 1), 1)))
        np.save(f"{own}/l{k}.{s}.prob.npy", quantise(share))
        return seen

    kinds = np.zeros(0, np.int64)

    def write(own):
        nonlocal kinds
        kinds = level(own, 2, pair_context, pair_word, pair_n, total)[layout.cold :]
        level(own, 3, in_pair, third, n, np.bincount(in_pair, n, len(head)))

    save(path, f"s{s}", write)
    at = np.flatnonzero(kinds)
    return {"hot": at, "kinds": kinds[at]}


def merged(batches, key: str, columns, at_end):
    """Streams blobs of (rows, counts) that come in order of their key and gives each key's sums to at_end: memory holds the distinct rows of one key."""
    def finish():
        rows, n = summed(np.concatenate(held[0]), np.concatenate(held[1]))
        return at_end(now, rows, n)

    now, held, size = None, ([], []), 0
    for pdf in batches:
        for k, rows, n in zip(pdf[key], pdf.rows, pdf.n, strict=True):
            if now is not None and k != now:
                yield pd.DataFrame([finish()])
                held, size = ([], []), 0
            now, n = k, np.frombuffer(n, np.int64 if key == "word_shard" else np.int32).astype(np.int64)
            held[0].append(columns(rows))
            held[1].append(n)
            size += len(n)
            if size > HELD:
                rows, n = summed(np.concatenate(held[0]), np.concatenate(held[1]))
                held, size = ([rows], [n]), 0
    if now is not None:
        yield pd.DataFrame([finish()])


def train(docs: DataFrame, discount: float = DISCOUNT, often: int = SHARD_TOKENS // 4) -> tuple[str, int]:
    """Counts every training text and writes the trie's levels to the shared folder; returns its path and the bits of a word's shard.

    Words, pairs and triples all count exactly. Tasks count their runs of text
    first and send each shard's rows as one blob; a shard's writer merges blobs
    as they come. The driver gets the counts of hot words, each of which occurs
    at least `often` times, a quarter of a shard. An empty corpus gives a trie without words.
    """
    path = local_path(shared_dir(docs.sparkSession))
    os.makedirs(path, exist_ok=True)
    texts = docs.where(~held_out(F.col("doc_id"), 10)).select(F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = (max(LEAST_SHARDS, -(-n_bytes // WORD_BYTES)) - 1).bit_length()
    shards = max(LEAST_SHARDS, -(-n_bytes // GRAM_BYTES))

    def words(batches):
        for pdf in byte_parts(batches, PART_BYTES):
            b = Batch(pdf.text)
            n = np.bincount(b.tokens, minlength=len(b.words))
            order = np.argsort(b.keys)
            keys, n = b.keys[order], n[order]
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            yield pd.DataFrame({"word_shard": shard[cuts[:-1]], "rows": [keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], "n": [n[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]})

    def write_words(s, keys, n):
        def write(own):
            EliasFano.write(f"{own}/w{s}", keys & np.uint64((1 << 64 - bits) - 1))
            np.save(f"{own}/w{s}.count.npy", n.astype(np.min_scalar_type(int(n.max()))))

        save(path, f"w{s}", write)
        at = np.flatnonzero(n >= often)
        return {"word_shard": s, "total": int(n.sum()), "v": len(n), "hot": at, "hot_n": n[at]}

    def dealt(df, key):
        return df.repartition(key).sortWithinPartitions(key)

    counted = dealt(texts.mapInPandas(lean(words), "word_shard long, rows binary, n binary"), "word_shard").mapInPandas(
        lambda batches: merged(batches, "word_shard", lambda x: np.frombuffer(x, np.uint64), write_words), "word_shard long, total long, v long, hot array<long>, hot_n array<long>").collect()
    counted.sort(key=lambda r: r.word_shard)
    offset = np.r_[0, np.cumsum([r.v for r in counted])].astype(np.int64)
    hot = [(o + i, n) for o, r in zip(offset, counted) for i, n in zip(r.hot, r.hot_n, strict=True)]
    np.save(f"{path}/shape.npy", np.array([shards, offset[-1], sum(r.total for r in counted)]))
    np.save(f"{path}/hot.npy", np.array(hot, np.int64).reshape(-1, 2).T)

    def grams(batches):
        words, layout = Words(path, bits), Layout(path)
        for pdf in byte_parts(batches, PART_BYTES):
            b = Batch(pdf.text)
            t = words.look_up(b.keys)[0][b.tokens]
            at = np.flatnonzero(b.nth > 0) - 1
            third = np.where(np.r_[b.nth, 0][at + 2] > 0, np.r_[t, 0][at + 2], layout.vocab)
            shard, context = layout.place(t[at], t[at + 1])
            rows, out = layout.pack(context, t[at + 1], third), []
            for s, own in by_shard(shard):
                part, n = summed(rows[own], np.ones(len(own), np.int64))
                out.append((s, part.tobytes(), n.astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["shard", "rows", "n"])

    def write_grams(batches):
        layout = Layout(path)
        columns = lambda x: np.frombuffer(x, np.int64) if layout.packs else np.frombuffer(x, np.int64).reshape(-1, 2)
        yield from merged(batches, "shard", columns, lambda s, rows, n: write_shard(path, layout, s, rows, n, discount))

    kinds = dealt(texts.mapInPandas(lean(grams), "shard long, rows binary, n binary"), "shard").mapInPandas(lean(write_grams), "hot array<long>, kinds array<long>")
    kinds = kinds.select(F.explode(F.arrays_zip("hot", "kinds")).alias("x")).groupBy("x.hot").agg(F.sum("x.kinds").alias("kinds")).collect()
    seen = np.zeros(len(hot))
    for r in kinds:
        seen[r.hot] = r.kinds
    np.save(f"{path}/hot_back.npy", np.where(seen > 0, discount * seen / np.maximum([n for _, n in hot], 1), 1.0) if hot else np.zeros(0))
    return path, bits


def score(docs: DataFrame, model: tuple[str, int]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts hold the end only, repeated rows stay, a null doc_id is
    not held out, other columns are left out, an empty table gives no rows. A
    model of an empty corpus knows no word: every token has the base's floor.
    """
    path, bits = model

    def run(batches):
        words, layout = Words(path, bits), Layout(path)
        trie, floor = Trie(path, layout), layout.n_all + 0.1 * (layout.vocab + 1)
        for pdf in byte_parts(batches, PART_BYTES):
            b = Batch(pdf.text)
            ids, counts = words.look_up(b.keys)
            base = ((counts + 0.1) / floor)[b.tokens]
            prob, t = base.copy(), ids[b.tokens]
            at = np.flatnonzero(b.nth > 0)
            pairs, inverse = np.unique(t[at - 1] + 1 << 32 | t[at] + 1, return_inverse=True)
            shard, p, back, place = trie.follow_pairs((pairs >> 32) - 1, (pairs & 0xFFFFFFFF) - 1)
            prob[at] = p[inverse] + back[inverse] * prob[at]
            pair = np.zeros(len(t), np.int64)
            pair[at] = inverse
            at = np.flatnonzero(b.nth > 1)
            triples, inverse = np.unique(pair[at - 1] << 32 | t[at] + 1, return_inverse=True)
            first = triples >> 32
            p, back, _ = trie.follow(3, shard[first], place[first], (triples & 0xFFFFFFFF) - 1)
            prob[at] = p[inverse] + back[inverse] * prob[at]
            sums = lambda x: np.add.reduceat(x, b.starts)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "n_tokens": b.sizes, "n_known": sums((counts[b.tokens] > 0).astype(np.int64)), "train_tokens": layout.n_all, "base_score": sums(np.log10(base)), "score": sums(np.log10(prob))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 10).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
