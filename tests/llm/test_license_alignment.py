"""License scans against plain dynamic programming, and every edited template found."""

import random

import numpy as np
import pytest

pytest.importorskip("factgraph.llm")
from factgraph.llm import license_scan  # noqa: E402


def plain(template, text, start, band):
    """(matched, first place) by the same rules, cell by cell."""
    width = 2 * band + 1
    before = [(0, 0)] * (width + 1)
    for i, word in enumerate(template):
        now = [(0, 0)] * (width + 1)
        for o in range(width):
            j = start + i + o - band
            best = before[o + 1]
            if 0 <= j < len(text) and text[j] == word:
                best = max(best, (before[o][0] + 1, before[o][1] if before[o][0] else j))
            now[o] = max(best, now[o - 1]) if o else best
        before = now
    return max(before[:width])


def in_order(template, text):
    row = [0] * (len(template) + 1)
    for word in text:
        for i in range(len(template), 0, -1):
            row[i] = max(row[i], row[i - 1] + 1) if template[i - 1] == word else row[i]
        for i in range(1, len(template) + 1):
            row[i] = max(row[i], row[i - 1])
    return row[-1]


def test_alignment_and_its_end():
    rng = random.Random(1)
    for _ in range(500):
        template, text = np.array([rng.randrange(6) for _ in range(rng.randint(1, 14))]), np.array([rng.randrange(7) for _ in range(rng.randint(0, 40))], np.int64)
        starts, band = np.array([rng.randint(-3, len(text)) for _ in range(5)]), rng.randint(1, 5)
        matched, first, end = license_scan.align(template, text, starts, band)
        for k in range(5):
            want = plain(template.tolist(), text.tolist(), int(starts[k]), band)
            assert (matched[k], first[k] if matched[k] else 0) == (want[0], want[1] if want[0] else 0)
            if matched[k]:
                last = license_scan.tight(template, text, int(first[k]), min(int(end[k]), len(text)), int(matched[k]))
                span = text[int(first[k]) : last].tolist()
                assert in_order(template.tolist(), span) >= matched[k] > in_order(template.tolist(), span[:-1])


def test_winnowing_leaves_a_fingerprint_in_every_run():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 40)
        template = [f"w{rng.randrange(12)}" for _ in range(n)]
        need = max(1, -(-n * 4 // 5))
        k, places = license_scan.fingerprints(template, need)
        run = license_scan.run_length(n, need)
        for start in range(n - run + 1):
            assert any(start <= p and p + k <= start + run for p in places)
        cuts = sorted(rng.sample(range(n), n - need))  # so many edits leave a run of that length
        assert max(b - a - 1 for a, b in zip([-1, *cuts], [*cuts, n], strict=True)) >= run


def test_templates_with_as_many_edits_as_are_allowed(spark):
    rng, rows, want = random.Random(3), [], []
    for name, text in license_scan.TEMPLATES:
        w = license_scan.words(text)
        need = next(x for x in range(len(w) + 1) if x >= license_scan.COVERAGE * len(w))
        for _ in range(6):
            edited = [[x] for x in w]
            for p in rng.sample(range(len(w)), len(w) - need):
                edited[p] = rng.choice([["zzz"], [], ["zzz", w[p]]])
            rows.append((len(rows), "intro zzz " + " ".join(x for part in edited for x in part) + " more", "x", 1, 2.0))
            want.append((name, need))
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, start int, coverage double")
    got = {}
    for r in license_scan.scan(docs).collect():
        got.setdefault((r.doc_id, r.license), []).append(r.matched)
    for i, (name, need) in enumerate(want):
        assert max(got[i, name]) >= need


def test_rows_nulls_and_long_texts(spark):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    rows = [(None, mit), (2**62 + 1, mit), (5, mit), (5, mit), (6, None), (7, ""), (8, "word " * 200_000 + mit), (9, "\n".join([mit] * 3000))]
    got = sorted((str(r.doc_id), r.start, r.end, r.matched) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.license == "MIT")
    assert [g for g in got if g[0] != "9"] == sorted([("None", 0, 5, 5), (str(2**62 + 1), 0, 5, 5), ("5", 0, 5, 5), ("5", 0, 5, 5), ("8", 200_000, 200_005, 5)])
    assert [g[1:] for g in sorted((g for g in got if g[0] == "9"), key=lambda g: g[1])] == [(5 * k, 5 * k + 5, 5) for k in range(3000)]
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
