"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, lean

SPACE, CACHE_WORDS, WORDS_AT_ONCE = "▁", 60_000, 12_000
#: A piece may start with spaces but none follows another character, so merges stay inside these parts.
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
SHIFT, SLOT_BITS, ODD = 21, 20, np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Merged piece of a pair of symbols: open addressing in arrays, all look-ups probe together."""

    def __init__(self, pairs: dict[int, int]):
        self.keys, self.values = np.full(1 << SLOT_BITS, -1, np.int64), np.full(1 << SLOT_BITS, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for slot, key in zip(self._slots(keys).tolist(), keys.tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.keys[slot], self.values[slot] = key, pairs[key]

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged piece of each pair, or -1."""
        keys = a.astype(np.int64) << SHIFT | b
        slots = self._slots(keys)
        seen, out = self.keys[slots], self.values[slots]
        live = np.flatnonzero((seen != keys) & (seen >= 0))
        out[seen != keys] = -1
        while len(live):
            slots[live] = (slots[live] + 1) & ((1 << SLOT_BITS) - 1)
            at = slots[live]
            hit = self.keys[at] == keys[live]
            out[live[hit]] = self.values[at[hit]]
            live = live[~hit & (self.keys[at] >= 0)]
        return out


class Codec:
    """A BPE model's pieces as arrays."""

    def __init__(self, model: bytes, add_eos: bool = True):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        scores = np.array([lib.get_score(i) for i in range(n)], np.float64)
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: b for b, i in enumerate(self.byte)}
        self.names = [str(i) for i in range(n)]
        #: Text of each piece; None for bytes, whose text depends on their neighbours.
        self.plain = [None if lib.is_byte(i) else "" if lib.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.eos = lib.eos_id() if add_eos else None
        # Two kinds of symbols: pieces by id, other characters by n + code point, which never merge.
        self.n = n
        self.symbol = np.arange(0x110000, dtype=np.int32) + n
        pairs = {}
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = i
        self.pairs = PairTable(pairs)
        order = np.unique(-scores)
        self.none = len(order)
        self.rank = np.r_[np.searchsorted(order, -scores), self.none].astype(np.int32)  # the last one: no piece
        #: Ids joined by spaces, and the text that they decode to, by part.
        self.known: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def _merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of the words, one after another, and how many each word has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lens) - lens
        head = np.zeros(len(sym) + 1, bool)
        head[starts], head[-1] = True, True
        piece = np.r_[self.pairs.get(sym[:-1], sym[1:]), np.int32(-1)]
        piece[np.r_[starts[1:], len(sym)] - 1] = -1
        rank, done = self.rank[piece], []
        while True:
            best = np.minimum.reduceat(rank, starts)
            over = best == self.none
            if over.any():
                gone = np.repeat(over, lens)
                done.append((sym[gone], word[gone]))
                stay = ~gone
                sym, word, rank, piece, head = sym[stay], word[stay], rank[stay], piece[stay], np.r_[head[:-1][stay], True]
                best, lens = best[~over], lens[~over]
                starts = np.cumsum(lens) - lens
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lens))
            # Leftmost merges first: of a run of overlapping pairs every second one, from the left.
            first = np.r_[True, np.diff(at) > 1]
            if not first.all():
                at = at[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            seg = np.searchsorted(starts, at, "right") - 1
            new, keep, left, left_piece, right_piece = self._merged(sym, piece, head, at)
            worse = np.minimum(self.rank[left_piece], self.rank[right_piece]) < best[seg]
            if worse.any():  # a new pair outranks this one: in these words only the leftmost merge is sure
                lead = np.r_[True, seg[1:] != seg[:-1]]
                at = at[lead | ~np.isin(seg, seg[worse])]
                seg = np.searchsorted(starts, at, "right") - 1
                new, keep, left, left_piece, right_piece = self._merged(sym, piece, head, at)
            # Only pairs beside a merge are new.
            piece[at] = right_piece
            inner = ~head[at]
            piece[left[inner]] = left_piece[inner]
            rank[at], rank[left[inner]] = self.rank[right_piece], self.rank[left_piece[inner]]
            sym, word, rank, piece, head = new[keep], word[keep], rank[keep], piece[keep], np.r_[head[:-1][keep], True]
            lens = lens - np.bincount(seg, minlength=len(lens))
            starts = np.cumsum(lens) - lens
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _merged(self, sym, piece, head, at):
        """Symbols after the merges, which of them stay, and left neighbours and new pieces on both sides of each merge."""
        new, keep = sym.copy(), np.ones(len(sym), bool)
        new[at] = piece[at]
        keep[at + 1] = False
        left = np.maximum(at - 1, 0)
        left = np.where(keep[left], left, at - 2)
        last = np.minimum(at + 2, len(sym) - 1)
        left_piece = np.where(head[at], -1, self.pairs.get(new[left], new[at]))
        right_piece = np.where(head[at + 2], -1, self.pairs.get(new[at], new[last]))
        return new, keep, left, left_piece, right_piece

    def _learn(self, words: list[str]) -> None:
        """Keeps the words' ids and texts."""
        sym, sizes = self._merge_rounds(words)
        ends = np.cumsum(sizes)
        spelled = np.logical_or.reduceat(sym >= self.n, ends - sizes).tolist()
        at, sym, names, plain = 0, sym.tolist(), self.names, self.plain
        for w, end, bytewise in zip(words, ends.tolist(), spelled, strict=True):
            own = sym[at:end]
            at = end
            if bytewise:
                own = [x for s in own for x in ([s] if s < self.n else [self.byte[b] for b in chr(s - self.n).encode()])]
                self.texts[w] = self._with_bytes(own)
            else:
                self.texts[w] = "".join([plain[i] for i in own])
            self.known[w] = " ".join([names[i] for i in own])

    def run(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Of each text its ids in decimal, joined by spaces, and the text that they decode to.

        Every part starts with a space's piece, so no run of byte pieces goes
        from one part into the next and the parts decode one by one.
        """
        parts = [PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        distinct = set().union(*parts)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.texts.clear()
            new = list(distinct)
        for i in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[i : i + WORDS_AT_ONCE])
        end = [] if self.eos is None else [self.names[self.eos]]
        ids = [" ".join([*map(self.known.__getitem__, p), *end]) for p in parts]
        decoded = ["".join(map(self.texts.__getitem__, p)) for p in parts]
        return ids, [t[1:] if t.startswith(" ") else t for t in decoded]

    def _with_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, out: str = "digest") -> DataFrame:
    """Encodes and decodes every text; model_path is read once on the driver (its size is fixed by the vocabulary).

    out 'digest': doc_id, n_tokens, ids_sha256, decoded_sha256; 'full': doc_id, ids, decoded.
    Null counts as empty: only the end id, decoded to ''. Repeated rows give
    repeated rows, an empty table none; other columns are left out. Any
    character without a piece becomes its UTF-8 bytes' pieces. Rows go through
    in runs of about a MB of text, so memory follows the longest text only.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = Codec(model.value)
        for pdf in byte_parts(batches, 1 << 20):
            ids, texts = codec.run([t or "" for t in pdf.text])
            if out == "full":
                yield pd.DataFrame({"doc_id": pdf.doc_id, "ids": [np.fromstring(s, np.int32, sep=" ") for s in ids], "decoded": texts})
            else:
                sha = lambda some: [hashlib.sha256(t.encode()).hexdigest() for t in some]
                yield pd.DataFrame({"doc_id": pdf.doc_id, "n_tokens": [s.count(" ") + (s != "") for s in ids], "ids_sha256": sha(ids), "decoded_sha256": sha(texts)})

    schema = "doc_id long, ids array<int>, decoded string" if out == "full" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(lean(run), schema)
