"""Fill-in-middle transformation on ropes: two splits by lines, subtrees put together anew, and back by splitting."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, lean

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
LEAF_CHARS, SEED, FIM_PERCENT, SPM_PERCENT = 4096, 7, 100, 50


class Rope:
    """A piece of text, or two ropes; `ends` (line ends) and `chars` (code points) are counted once."""

    __slots__ = ("chars", "ends", "left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.ends, self.chars = text.count("\n"), len(text)
        else:
            self.ends, self.chars = left.ends + right.ends, left.chars + right.chars

    @staticmethod
    def of(text: str, leaf_chars: int = LEAF_CHARS) -> Rope:
        level = [Rope(text[i : i + leaf_chars]) for i in range(0, len(text), leaf_chars)] or [Rope()]
        while len(level) > 1:
            level = [Rope.joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    @staticmethod
    def joined(*parts: Rope) -> Rope:
        """The parts in order; empty ones leave no node."""
        out = Rope()
        for p in parts:
            if p.chars:
                out = Rope(left=out, right=p) if out.chars else p
        return out

    def split(self, rank: int, count: str) -> tuple[Rope, Rope]:
        """Before and after the rank-th line end (count 'ends') or code point ('chars'); a rank beyond them takes all."""
        if rank <= 0:
            return Rope(), self
        if rank > getattr(self, count):
            return self, Rope()
        if self.left is None:
            at = rank if count == "chars" else [m.end() for m in re.finditer("\n", self.text)][rank - 1]
            return Rope(self.text[:at]), Rope(self.text[at:])
        here = getattr(self.left, count)
        if rank <= here:
            a, b = self.left.split(rank, count)
            return a, Rope.joined(b, self.right)
        a, b = self.right.split(rank - here, count)
        return Rope.joined(self.left, a), b

    def lines(self) -> int:
        """Line ends, and one more where text follows the last."""
        last = self
        while last.left is not None:
            last = last.right
        return self.ends + (last.text[-1:] not in ("", "\n"))

    def __str__(self) -> str:
        out, left = [], [self]
        while left:
            node = left.pop()
            if node.left is None:
                out.append(node.text)
            else:
                left += (node.right, node.left)
        return "".join(out)


def draws(key: str, seed: int = SEED) -> list[int]:
    """The four numbers that decide on a document's cuts and form."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(text: str, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """Lines, form, code points of prefix and middle, and the output."""
    rope = Rope.of(text)
    n = rope.lines()
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    # A rank of all lines takes the text behind the last line end too.
    rest, suffix = rope.split(last, "ends") if last < n else (rope, Rope())
    prefix, middle = rest.split(first, "ends") if first < n else (rest, Rope())
    p, s, m = map(Rope, SENTINELS)
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = Rope.joined(s, suffix, p, prefix, m, middle) if form == "spm" else Rope.joined(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, str(out)


def restored(output: str, form: str) -> str:
    """The text that was rearranged: the output's rope, split at the sentinels."""
    if form == "plain":
        return output
    opening, between = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    # No text holds a sentinel, and none can arise where text and sentinel meet.
    second = output.index(between, len(opening))
    third = output.index(MIDDLE, second + len(between))
    rest, middle = Rope.of(output).split(third + len(MIDDLE), "chars")
    rest, _ = rest.split(third, "chars")
    rest, b = rest.split(second + len(between), "chars")
    rest, _ = rest.split(second, "chars")
    _, a = rest.split(len(opening), "chars")
    return str(Rope.joined(b, middle, a) if form == "spm" else Rope.joined(a, middle, b))


def fill_middle(docs: DataFrame, out: str = "digest", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Cuts every text at two line ranks and moves its middle behind the rest; the text is rebuilt from the output as a proof.

    out 'digest': doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; 'full': output and restored instead
    of their digests. A null text counts as empty, and an empty one stays plain; a null doc_id draws as the empty string. Equal
    rows give equal rows, an empty table none; other columns are left out, whatever their names. Two equal ranks leave an empty
    middle. Texts go through in runs of a few MB, so memory follows the longest text only; no row leaves its partition.
    """
    def run(batches):
        for pdf in byte_parts(batches):
            made = [rearranged(t, k, seed, fim_percent, spm_percent) for t, k in zip(pdf.text, pdf.key, strict=True)]
            back = [restored(m[4], m[1]) for m in made]
            cols = {"doc_id": pd.array([int(k) if k else None for k in pdf.key], "Int64"), "n": [m[0] for m in made], "form": [m[1] for m in made]}
            cols |= {"prefix_chars": pd.array([m[2] for m in made], "Int64"), "middle_chars": pd.array([m[3] for m in made], "Int64")}
            if out == "full":
                cols |= {"output": [m[4] for m in made], "restored": back}
            else:
                cols |= {"output_sha256": [hashlib.sha256(m[4].encode()).hexdigest() for m in made], "restored_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back]}
            yield pd.DataFrame(cols)

    ends = "output string, restored string" if out == "full" else "output_sha256 string, restored_sha256 string"
    # doc_id goes through as text: a column of longs with a null would reach pandas as doubles.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(lean(run), f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {ends}")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * CAST(i AS INT) + 1, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
cuts AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
      WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
