"""Byte-level BPE encoding and decoding: a minimal transducer of the corpus's frequent words, exact merges for all others."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import byte_parts, lean, shared_dir, stored
from .sentencepiece_codec import SHIFT, Codec, PairTable

#: A word is frequent if it is one of so many words at least; the lexicon has no more words than that.
SHARE = 1 << 18
#: Longer words, in bytes, are never in the lexicon.
LONGEST_WORD = 48
CACHE_WORDS, WORDS_AT_ONCE = 300_000, 50_000

#: Fixed value: the words of byte-level BPE, as the vocabulary's own library and documentation state them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---- words

def _ranges(points: list[int]) -> str:
    """The code points as the inside of a character class."""
    at = np.array(points, np.int64)
    cut = np.flatnonzero(np.diff(at) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist(), strict=True))


def word_patterns(split) -> list[str]:
    """PATTERN for texts of ASCII, of the basic plane and of any characters, with the library's Unicode version.

    Where this Python and the regex module put a character into different
    classes (it is newer than one of them), the library's `split` is asked.
    """
    every = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, every))
    known = np.full(sys.maxunicode + 1, "P")
    for kind, pattern in (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+")):
        for m in regex.finditer(pattern, text):
            known[every[m.start()] : every[m.end() - 1] + 1] = kind
    known[0xD800:0xE000] = "P"
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": [], "P": []}
    for code in every:
        c = chr(code)
        own = unicodedata.category(c)[0]
        own = own if own in "LN" else "S" if c.isspace() else "P"
        if own != known[code]:
            own = next((k for k, beside in (("L", "a"), ("N", "1"), ("P", "!")) if len(split(beside + c)) == 1), "S")
        kinds[own].append(code)
    out = []
    for end in (0x80, 0x10000, sys.maxunicode + 1):
        letters, numbers, spaces = (_ranges([c for c in kinds[k] if c < end]) for k in "LNS")
        out.append(PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))
    return out


class Splitter:
    def __init__(self, patterns: list[str], added: dict[str, int]):
        self.ascii, self.basic, self.any = (re.compile(p).findall for p in patterns)
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.ids = added

    def words(self, text: str) -> list[str]:
        """The text in words; an added token stands for itself."""
        if self.added is None or not any(a in text for a in self.ids):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.added(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text) if self.beyond(text) else self.basic(text)


# ---- lexicon

class _State:
    __slots__ = ("arcs", "final", "out")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, state, ids]
        self.final, self.out = False, ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def compile_lexicon(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal acyclic transducer of distinct words in ascending order and their ids, as one array of int32.

    Equal suffixes with equal outputs are one state. Outputs stand as near to
    the start as all words through an arc agree on them; what is left of a
    word that others continue stands at its last state. Head: states, arcs,
    ids; then arcs in order of (state, byte): key, target; outputs of arcs and
    of states: start; the ids; states' ends: 1 where a word ends.
    """
    register: dict = {}
    frozen: list[tuple] = []
    path, last = [_State()], b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            key = (state.final, state.out, tuple((b, t, o) for b, t, o in state.arcs))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            path[-1].arcs[-1][1] = register[key]

    for word, ids in words:
        same = _common(word, last)
        freeze(same)
        for depth in range(same):
            arc, below = path[depth].arcs[-1], path[depth + 1]
            n = _common(arc[2], ids)
            if rest := arc[2][n:]:
                for a in below.arcs:
                    a[2] = rest + a[2]
                if below.final:
                    below.out = rest + below.out
            arc[2], ids = arc[2][:n], ids[n:]
        for depth in range(same, len(word)):
            path[-1].arcs.append([word[depth], None, ids if depth == same else ()])
            path.append(_State())
        path[-1].final = True
        if same == len(word):
            path[-1].out = ids
        last = word
    freeze(0)
    root = path[0]
    frozen.append((root.final, root.out, tuple((b, t, o) for b, t, o in root.arcs)))
    keys, targets, outs = [], [], []
    for s, (_, _, arcs) in enumerate(frozen):
        for b, t, o in arcs:
            keys.append(s << 8 | b)
            targets.append(t)
            outs.append(o)
    outs += [s[1] for s in frozen]
    starts = np.cumsum([0, *map(len, outs)])
    ids = [i for o in outs for i in o]
    return np.concatenate([[len(frozen), len(keys), len(ids)], keys, targets, starts, ids, [s[0] for s in frozen]]).astype(np.int32)


class Lexicon:
    """A compiled lexicon; all words walk through it together."""

    def __init__(self, packed: np.ndarray):
        n_states, n_arcs, n_ids = packed[:3].tolist()
        parts = np.split(packed[3:], np.cumsum([n_arcs, n_arcs, n_arcs + n_states + 1, n_ids]))
        self.keys, self.targets, self.starts, self.ids, self.ends = parts
        self.root, self.n_arcs = n_states - 1, n_arcs

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are there, all their ids, one word after another, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        there = (lens > 0) & (lens <= LONGEST_WORD)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lens) - lens
        state = np.full(len(words), self.root, np.int64)
        passed = np.full((len(words), int(lens[there].max(initial=0)) + 1), -1, np.int32)
        live = np.flatnonzero(there)
        for step in range(passed.shape[1]):
            over = lens[live] == step
            done = live[over]
            ends = self.ends[state[done]] == 1
            there[done[~ends]] = False
            passed[done[ends], step] = self.n_arcs + state[done[ends]]
            live = live[~over]
            if not len(live):
                break
            key = state[live] << 8 | raw[first[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), self.n_arcs - 1)
            hit = self.keys[at] == key if self.n_arcs else np.zeros(len(key), bool)
            there[live[~hit]] = False
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            passed[live, step] = at
        passed[~there] = -1
        steps = passed[passed >= 0]
        size = self.starts[steps + 1] - self.starts[steps]
        per_word = np.zeros(len(words), np.int64)
        np.add.at(per_word, np.nonzero(passed >= 0)[0], size)
        offset = np.cumsum(size) - size
        return there, self.ids[np.repeat(self.starts[steps] - offset, size) + np.arange(int(size.sum()))], per_word


# ---- codec

class ByteCodec(Codec):
    """Merge rounds over bytes: a word's bytes as characters, every merge a piece of its own."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        chars = byte_chars()
        self.n = max(vocab.values()) + 1
        self.symbol = np.array([vocab[c] for c in chars], np.int32)
        pairs, rank = {}, np.full(self.n, -1, np.int32)
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            if rank[made] >= 0:
                raise ValueError("two merges make one piece")
            pairs[vocab[a] << SHIFT | vocab[b]], rank[made] = made, i
        self.pairs, self.none = PairTable(pairs), len(model["merges"])
        rank[rank < 0] = self.none
        self.rank = np.r_[rank, np.int32(self.none)].astype(np.int32)
        of = {c: b for b, c in enumerate(chars)}
        self.bytes_of_id = {i: bytes(of[c] for c in piece) for piece, i in vocab.items()}

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and how many each has."""
        return self._merge_rounds([w.decode("latin-1") for w in words])


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


class Encoder:
    """Splitter, lexicon and merges; keeps the ids and texts of the words met last."""

    def __init__(self, model: dict, patterns: list[str], added: dict[str, int], packed: np.ndarray):
        self.split, self.lexicon, self.codec = Splitter(patterns, added), Lexicon(packed), ByteCodec(model)
        self.names = {i: str(i) for i in [*self.codec.bytes_of_id, *added.values()]}
        self.pieces = self.codec.bytes_of_id | {i: a.encode() for a, i in added.items()}
        self.added = {a: str(i) for a, i in added.items()}
        self.known: dict[str, str] = {}
        #: Decoded texts of words that do not decode to themselves.
        self.odd: dict[str, str] = {}

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        there, ids, sizes = self.lexicon.find(raw)
        self._keep([w for w, t in zip(words, there.tolist(), strict=True) if t], ids, sizes[there])
        rest = np.flatnonzero(~there).tolist()
        if rest:
            self._keep([words[i] for i in rest], *self.codec.merged([raw[i] for i in rest]))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, ids, names, pieces = 0, ids.tolist(), self.names, self.pieces
        for w, end in zip(words, np.cumsum(sizes).tolist(), strict=True):
            own = ids[at:end]
            at = end
            self.known[w] = ",".join([names[i] for i in own])
            decoded = b"".join([pieces[i] for i in own]).decode("utf-8", "replace")
            if decoded != w:
                self.odd[w] = decoded

    def run(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Of each text its ids in decimal, joined by commas, and the text that they decode to: every word is whole characters, so words decode one by one."""
        parts = [self.split.words(t) for t in texts]
        distinct = set().union(*parts)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.odd.clear()
            new = list(distinct)
        self.known |= self.added
        new = [w for w in new if w not in self.added]
        for i in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[i : i + WORDS_AT_ONCE])
        decoded = ["".join([self.odd.get(w, w) for w in p] if self.odd else p) for p in parts]
        return [",".join(map(self.known.__getitem__, p)) for p in parts], decoded


# ---- Spark

def frequent_words(docs: DataFrame, share: int = SHARE) -> list[str]:
    """The words that are at least one of `share` words of all texts: `share` words at most, however large the corpus.

    Counted in the JVM over whole texts; words there split at ASCII white
    space, which decides only what is in the lexicon, never a result.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("word"))
    total = Observation()
    counts = words.groupBy("word").agg(F.count("*").alias("n")).observe(total, F.sum("n").alias("words"))
    counts = stored(counts.where((F.col("n") > 1) & (F.octet_length("word") <= LONGEST_WORD)))
    least = (total.get["words"] or 0) / share
    return [r.word for r in counts.where(F.col("n") >= least).select("word").toLocalIterator()]


def _shared_file(spark: SparkSession, data: bytes) -> str:
    """Name under which every executor gets the bytes as a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + ".lexicon")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def encode_decode(docs: DataFrame, tokenizer_path: str, out: str = "digest", share: int = SHARE) -> DataFrame:
    """Encodes every text with a byte-level BPE vocabulary and decodes the ids; tokenizer_path is read once on the driver.

    out 'digest': doc_id, n_tokens, ids_sha256, decoded_sha256; 'full': doc_id, ids, decoded. The words that occur most (see
    frequent_words) are compiled into a transducer on the driver, which `share` bounds; executors get it as a file through Spark
    and map it into memory. All other words are merged exactly. Added tokens in a text stand for themselves. A null text counts
    as empty: no ids, decoded to ''. Equal rows give equal rows, an empty table none; other columns are left out, whatever their
    names. Words of equal counts do not compete: a lexicon only saves work. Texts go through in runs of a few MB, so memory
    follows the longest text only.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    split, added = Tokenizer.from_file(tokenizer_path).pre_tokenizer.pre_tokenize_str, {a["content"]: a["id"] for a in spec["added_tokens"]}
    if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
        raise ValueError(f"{tokenizer_path}: only plain byte-level vocabularies are supported")
    spark, patterns = docs.sparkSession, word_patterns(split)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = sorted({w.encode() for w in frequent_words(rows, share) if w and w not in added})
    ids, sizes = ByteCodec(spec["model"]).merged(words) if words else (np.zeros(0, np.int32), [])
    ends = np.cumsum(sizes).tolist()
    packed = compile_lexicon((w, tuple(ids[e - n : e].tolist())) for w, n, e in zip(words, sizes, ends, strict=True))
    name = _shared_file(spark, packed.astype("<i4").tobytes())
    model = spark.sparkContext.broadcast((spec["model"], patterns, added))  # its size is the vocabulary's

    def run(batches):
        encoder = Encoder(*model.value, np.memmap(SparkFiles.get(name), "<i4", "r"))
        sha = lambda some: [hashlib.sha256(t.encode()).hexdigest() for t in some]
        for pdf in byte_parts(batches):
            ids, texts = encoder.run(pdf.text.tolist())
            cols = {"doc_id": pd.array([None if d is None else int(d) for d in pdf.doc_id], "Int64")}
            if out == "full":
                yield pd.DataFrame(cols | {"ids": [np.fromstring(s, np.int32, sep=",") for s in ids], "decoded": texts})
            else:
                yield pd.DataFrame(cols | {"n_tokens": [s.count(",") + (s != "") for s in ids], "ids_sha256": sha(ids), "decoded_sha256": sha(texts)})

    schema = "doc_id long, ids array<int>, decoded string" if out == "full" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInPandas(lean(run), schema)
