"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
DOCS_PER_LANG, WINDOWS_PER_DOC, EPOCHS, SEED, ROWS = 400, 4, 12, 7, 512


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's categories L is in it."""
    return any(unicodedata.category(c)[0] == "L" for c in text if c.isalpha())


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All of data in windows of one length; the last one reaches back, a short text is padded with zeros."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= size:
        return np.pad(b, (0, size - len(b)))[None, :]
    starts = np.minimum(np.arange(0, len(b), size), len(b) - size)
    return np.lib.stride_tricks.sliding_window_view(b, size)[starts]


class ByteCnn:
    """One-hot bytes, filters of several widths, max pooling over places, softmax.

    A filter of width k is k tables of 256 byte weights. Only the place that won
    the pooling gets a gradient, so a step costs no more than the pooled outputs.
    """

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.conv = [rng.normal(0, 0.3, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Weights by byte pair: a filter then needs one look-up for two bytes."""
        out = []
        for w in self.conv:
            pair = (w[0][:, None] + w[1][None]).reshape(65536, FILTERS)
            rest = None if len(w) == 2 else w[2] if len(w) == 3 else (w[2][:, None] + w[3][None]).reshape(65536, FILTERS)
            out.append((pair, rest))
        return out

    def pooled(self, x: np.ndarray, tables=None, places: bool = False):
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        feats, wins = [], []
        for w, (first, rest) in zip(self.conv, tables or self._tables(), strict=True):
            k, n = len(w), x.shape[1] - len(w) + 1
            act = first[pair[:, :n]]
            if k == 3:
                act = act + rest[x[:, 2 : 2 + n]]
            elif k == 4:
                act = act + rest[pair[:, 2 : 2 + n]]
            feats.append(act.max(axis=1))
            if places:
                wins.append(act.argmax(axis=1))
        return (np.concatenate(feats, axis=1), wins) if places else np.concatenate(feats, axis=1)

    def log_probs(self, x: np.ndarray, tables=None) -> np.ndarray:
        parts = [self.pooled(x[i : i + 64], tables) for i in range(0, len(x), 64)]
        z = np.maximum(np.concatenate(parts), 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> None:
        rng = np.random.default_rng(SEED)
        params = [*self.conv, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                xb, yb = x[batch], y[batch]
                feats, wins = self.pooled(xb, places=True)
                act = np.maximum(feats, 0)
                z = act @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.out.T) * (feats > 0)
                grads = []
                for j, (w, at) in enumerate(zip(self.conv, wins, strict=True)):
                    g = np.zeros_like(w)
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for i in range(len(w)):
                        np.add.at(g[i], (np.take_along_axis(xb, at + i, axis=1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                t += 1
                for i, g in enumerate([*grads, act.T @ p, p.sum(axis=0)]):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    params[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def held_out(doc_id, mod: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> ByteCnn | None:
    """Fits on a bounded sample: about docs_per_lang labelled texts of each language outside the held-out fold, WINDOWS_PER_DOC windows of each.

    The sample's share follows from the labels' counts over all rows, and a
    hash of doc_id decides; the driver gets only windows of a fixed length.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5)).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1_000_000, 1_000_000 * docs_per_lang // n + 1))).otherwise(share)

    def cut(batches):
        for pdf in batches:
            rows = []
            for text, lang in zip(pdf.text, pdf.lang, strict=True):
                if has_letter(text):
                    w = windows(text.encode())
                    rows += [(lang, w[i].tobytes()) for i in sorted({int(j) for j in np.linspace(0, len(w) - 1, min(len(w), WINDOWS_PER_DOC))})]
            yield pd.DataFrame(rows, columns=["lang", "win"])

    rows = labelled.where(spread < share).select("lang", "text").mapInPandas(lean(cut), "lang string, win binary").orderBy("lang", "win").toPandas()
    if not len(rows):
        return None
    langs = sorted(set(rows.lang))
    x = np.stack([np.frombuffer(w, np.uint8) for w in rows.win])
    net = ByteCnn(langs)
    net.fit(x, np.array([langs.index(v) for v in rows.lang]))
    return net


def identify(docs: DataFrame, net: ByteCnn | None, carry: list[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text's windows.

    The score is the softmax of the windows' mean log probabilities. Null texts,
    texts without a letter and, where nothing could be learned, all texts are
    'und' with score 0. Repeated rows give repeated rows, an empty table none.
    Other columns are left out, except those to carry.
    """
    carry = list(carry)

    def run(batches):
        tables = net and net._tables()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            text = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(text), [0.0] * len(text)
            rows = [i for i, t in enumerate(text) if net and t is not None and has_letter(t)]
            for part in range(0, len(rows), 256):
                idx = rows[part : part + 256]
                wins = [windows(text[i].encode()) for i in idx]
                starts = np.cumsum([0, *map(len, wins[:-1])])
                mean = np.add.reduceat(net.log_probs(np.concatenate(wins), tables), starts) / np.array([len(w) for w in wins])[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, row in zip(idx, p, strict=True):
                    langs[i], scores[i] = net.langs[int(row.argmax())], float(row.max())
            columns = ["id", "held_out", *[f"carried_{i}" for i in range(len(carry))]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), held_out(F.col("doc_id"), 5).alias("held_out"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)], F.col("text").alias("text"))
    kinds = "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    found = rows.mapInArrow(lean(run), f"id long, held_out boolean{kinds}, lang_pred string, score double")
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])
