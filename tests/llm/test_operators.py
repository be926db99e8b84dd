"""Operators against brute force on small fixtures with nulls, empty texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("factgraph.llm")
from factgraph.llm import decontaminate, elias_fano, html_text, language_id, license_scan, ngram_join, ngram_lm, sentencepiece_codec, suffix_dedup, topk, url_filter  # noqa: E402
from factgraph.llm.queries import tokenizer_model  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, seg string, h long, n int"


def texts():
    rng = random.Random(3)
    vocab = ["stone", "River", "a", "of", "light", "ümlaut", "日本"]
    base = [" ".join(rng.choices(vocab, k=n)) for n in (0, 1, 2, 12, 40, 120, 400)]
    near = base[6].split(" ")
    near[200] = "other"
    return [*base, None, "  \n", base[5], " ".join(near), base[4] + " " + base[5], "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in enumerate(texts())], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("size", [32, 50, 150])
def test_suffix_dedup(docs, empty, size):
    first, raws = {}, [(t or "").encode() for t in texts()]
    for i, b in enumerate(raws):
        for j in range(len(b) - size + 1):
            first.setdefault(b[j : j + size], i)
    got = {r.doc_id: r for r in suffix_dedup.dedup(docs, size).collect()}
    for i, b in enumerate(raws):
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if first[b[j : j + size]] < i:
                gone[j : j + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_null_and_repeated_ids(spark):
    """Each row against all rows of smaller doc_ids, null last; ids beyond 53 bits beside nulls."""
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choices(["stone", "river", "light", "grass", "cloud", "north"], k=n))
    shared, big = [line(20) for _ in range(6)], (1 << 60) + 1
    rows = [(1, shared[0] + line(15)), (2, shared[0] + line(15)), (2, line(30)), (3, rows3 := line(40)), (4, rows3), (4, line(40)), (None, shared[1] + line(9)), (None, shared[1] + shared[0]), (None, rows3)]
    rows += [(big + i, line(5) + shared[i % 6] + line(5)) for i in range(12)] + [(big, None), (5, "short")]
    first = {}
    for i, t in rows:
        for j in range(len(t or "") - 49):
            first[t[j : j + 50]] = min(first.get(t[j : j + 50], 1 << 63), i or 1 << 62)
    want = []
    for i, t in rows:
        gone = bytearray(len(t or ""))
        for j in range(len(gone) - 49):
            if first[t[j : j + 50]] < (i or 1 << 62):
                gone[j : j + 50] = b"\1" * 50
        want.append((str(i), "".join(c for c, g in zip(t or "", gone) if not g)))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted(want)


def test_shingle_sets():
    """As many shingles as distinct word triples, whatever shares a chunk; equal sets for equal words only."""
    cases = [None, "", " \t", "A", "a b", "a B\nc", "a  b\tc d", "d a b c", "b a c", "a c b", "x" * 70_000 + " y z", *texts(), " ".join(f"w{i % 977}q{i % 31}" for i in range(120_000))]
    got, seen = ngram_join.shingle_sets(cases, 3), {}
    for t, s in zip(cases, got, strict=True):
        w = t.encode().lower().split() if t else []
        want = frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()
        assert len(s) == len(want) and np.all(s[1:] > s[:-1])
        assert seen.setdefault(s.tobytes(), want) == want
    assert len(seen) == len(set(seen.values()))


def test_ngram_join(docs, empty):
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.replace("R", "r") if t else "")
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 90 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert ngram_join.join(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    t = texts()
    items = spark.createDataFrame([(1, t[5][:90], "x"), (2, "stone river", "x"), (3, None, "x"), (4, "", "x")], "item_id long, text string, n string")
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").replace("R", "r"))
    wins = {tuple(w[i : i + 10]) for w in map(low, (t[5][:90], "stone river")) for i in range(max(1, len(w) - 9))}
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, items).collect()}
    for i, s in enumerate(t):
        w, hit = low(s), set()
        for win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
        assert got[i] == len(hit)
    assert decontaminate.decontaminate(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0


def test_sentencepiece_equals_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_model())
    for r in sentencepiece_codec.encode_decode(docs, tokenizer_model(), "full").collect():
        ids = lib.encode(texts()[r.doc_id] or "", add_eos=True)
        assert (list(r.ids), r.decoded) == (ids, lib.decode(ids))


def test_url_filter_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    got = url_filter.url_filter(spark.read.parquet(f"{SF}/pages.parquet"), url_filter.rules_frame(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(url_filter.ORACLE).fetchall(), key=str)
    odd = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.COM/en/x"), (4, "h://com"), (4, "h://com")], "page_id long, url string")
    assert sorted((r.page_id, r.host, r.verdict) for r in url_filter.url_filter(odd, url_filter.rules_frame(spark)).collect()) == [(1, "", "allow"), (2, "", "allow"), (3, "a.com", "block"), (4, "com", "allow"), (4, "com", "allow")]


def test_top_k_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(map(tuple, topk.top_k(spark.read.parquet(f"{SF}/embeddings.parquet")).collect())) == sorted(con.execute(topk.ORACLE).fetchall())
    odd = spark.createDataFrame([(0, [1.0, -2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [1.0, -2.0]), (6, [1.0, -2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(odd).orderBy("rank").collect()] == [(0, 1, 4, 327680), (0, 2, 6, 327680)]
    assert topk.top_k(odd.where("false")).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(odd.union(spark.createDataFrame([(7, [1e30, 0.0])], odd.schema))).collect()


def test_top_k_blocks_and_ties(spark, monkeypatch):
    """Several blocks of rows and queries, ties, repeated rows and columns of the operator's own names."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(0, 240, 2)] * 2
    got = topk.top_k(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, query_block int")).collect()
    want = []
    for q, v in dict(rows).items():
        if q % 50 == 0:
            best = sorted((-int(65536 * sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_elias_fano_round_trip(tmp_path):
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 500)).astype(np.uint64)
    elias_fano.EliasFano.write(f"{tmp_path}/x", values)
    ef = elias_fano.EliasFano(f"{tmp_path}/x")
    assert (ef.get(np.arange(500)) == values).all()
    assert (ef.find(values, np.zeros(500), np.full(500, 500)) >= 0).all()
    assert (ef.find(values[:1] + np.uint64(1), np.zeros(1), np.full(1, 500)) == -1).all()


def test_language_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in ngram_lm.score(docs, ngram_lm.train(docs)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_equals_counts(spark, docs, empty):
    """Every pair and triple counts, also those seen once; unseen contexts leave all weight to the lower order."""
    rng, rows = random.Random(5), [(i, t) for i, t in enumerate(texts())]
    rows += [(100 + i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(0, 60)))) for i in range(60)]
    lines = [(i, (t or "").encode().lower().split() + [b"\n"], zlib.crc32(str(i).encode()) % 10 == 0) for i, t in rows]
    grams = [Counter(tuple(w[i : i + k]) for _, w, held in lines if not held for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    n_all, vocab = sum(grams[0].values()), len(grams[0])
    after = [defaultdict(list), defaultdict(list)]
    for k in (1, 2):
        for g, n in grams[k].items():
            after[k - 1][g[:-1]].append(n)

    def prob(g):
        if len(g) == 1:
            return (grams[0][g] + 0.1) / (n_all + 0.1 * (vocab + 1))
        seen = after[len(g) - 2].get(g[:-1])
        return prob(g[1:]) if not seen else (max(grams[len(g) - 1][g] - 0.75, 0) + 0.75 * len(seen) * prob(g[1:])) / sum(seen)

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert any(held for _, _, held in lines)
    for often in (1 << 20, 20):  # without and with words that are spread over all shards
        got = {r.doc_id: r for r in ngram_lm.score(frame, ngram_lm.train(frame, often=often)).collect()}
        assert len(got) == len(rows)
        for i, w, held in lines:
            assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (held, len(w), n_all)
            assert got[i].n_known == sum(grams[0][(x,)] > 0 for x in w)
            assert abs(got[i].base_score - sum(math.log10(prob((x,))) for x in w)) < 1e-6
            assert abs(got[i].score - sum(math.log10(prob(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w)))) < 3e-4 * len(w)
    assert ngram_lm.score(docs, ngram_lm.train(empty)).count() == len(texts())


def test_language_id_held_out(spark, docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(rows)
    out = [r for r in language_id.identify(rows, net).join(rows.select("doc_id", "lang"), "doc_id").collect() if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert {r.doc_id for r in language_id.identify(docs, net).where("lang_pred = 'und'").collect()} == {0, 7, 8}
    assert [language_id.has_letter(t) for t in ("½ ²", "１٣ 5", "", "a", "日", "ª", "Ⅷ")] == [False, False, False, True, True, True, False]


def test_html():
    page = '<html><body><nav><a href=x>m</a></nav><div class="ad">Buy, now</div><article><h1>T &amp; x</h1><p>One,\n two<p>Three</article><div id="comments"><p>No</p></div><footer>f</footer>'
    assert html_text.extract(page) == "T & x\n\nOne, two\n\nThree"
    assert html_text.extract(None) == "" and html_text.extract("") == ""


def test_html_named_wrappers():
    body = "<h1>Head</h1><p>One, two and three, with more words than others have.</p><p>Four, five.</p>"
    want = "Head\n\nOne, two and three, with more words than others have.\n\nFour, five."
    for name in ("content with-sidebar", "has-sidebar", "main no-sidebar", "site header-fixed"):
        for inner in (body, f"<article>{body}</article>", f"<main>{body}</main>"):
            assert html_text.extract(f'<html><body><div class="{name}">{inner}</div><div class="sidebar"><p>Side</p></div></body></html>') == want
    for name in ("entry-header", "post-header"):
        page = f'<body><article><div class="{name}"><h1>Head</h1></div>{body[13:]}</article><div id="comments"><article><p>No, no, no</p></article></div>'
        assert html_text.extract(page) == want
    page = "<body><section>Before, bare <b>bold</b> text.<div><p>One, two, three, four, five, six.</p><p>Seven, eight, nine.</p></div>After <br>it.</section></body>"
    assert html_text.extract(page) == "Before, bare bold text.\n\nOne, two, three, four, five, six.\n\nSeven, eight, nine.\n\nAfter it."


def test_html_names_depth_and_articles():
    body = "<h1>Head</h1><p>One, two and three, with more words than others have.</p>"
    kept = "Head\n\nOne, two and three, with more words than others have."
    assert html_text.extract(f'<body><article>{body}<p class="related work">Work, that is related.</p><div class="side by side">Both.</div></article>') == f"{kept}\n\nWork, that is related.\n\nBoth."
    assert html_text.extract(f'<body><main><article>{body}</article><article>{body}</article></main>') == f"{kept}\n\n{kept}"
    assert html_text.extract(f'<body><div class="page no-sidebar">{body}</div>') == kept
    assert html_text.extract("<body><article><p>One<br>two<br/>three</p></article>") == "One two three"
    deep = "<blockquote>" * 4000 + "<p>Deep, deeper.</p>" + "</blockquote>" * 4000
    assert html_text.extract(f"<body><article>{body}{deep}</article>") == f"{kept}\n\nDeep, deeper."


def test_html_pages_equal_their_articles():
    """Brute force for the supplied pages, whose text is all in one article: tags are cut from it by patterns."""
    import html

    for page, url in duckdb.connect().execute(f"SELECT html, url FROM read_parquet('{SF}/pages.parquet')").fetchall():
        inside = re.search(r"<article>(.*)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h1|ul|li)[^>]*>", re.sub(r"<!--.*?-->", "", inside.group(1), flags=re.S)) if inside else []
        want = "\n\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m.group().startswith("<br") else "", x)).split()) for x in parts) if t)
        assert html_text.extract(page) == want


def test_license_scan(spark):
    rows = [(1, "intro. Released under the MIT License. more"), (2, "nothing here"), (3, None), (4, "Licensed under the Apache Software License, Version 2.0.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.start, r.end, r.matched) for r in got) == [(1, "MIT", 1, 6, 5), (4, "Apache-2.0", 0, 8, 7)]


def test_license_scan_edits_and_adjacent_copies(spark):
    """Each notice with any one word replaced, dropped or added is found; every copy of adjacent ones is reported."""
    short, rows, want = license_scan.TEMPLATES[:6], [], []
    for name, text in license_scan.TEMPLATES:
        w = license_scan.words(text)
        for k in range(0, len(w), max(1, len(w) // 12)):
            for edited, missing in ((w[:k] + ["zzz"] + w[k + 1 :], 1), (w[:k] + w[k + 1 :], 1), (w[:k] + ["zzz"] + w[k:], 0)):
                rows.append((len(rows), "intro zzz " + " ".join(edited) + " more"))
                want.append((name, len(w) - missing))
    edits = len(rows)
    rows += [(len(rows) + i, "\n".join([text] * 4)) for i, (_, text) in enumerate(short)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end, r.matched))
    for i, (name, matched) in enumerate(want):
        assert [g[3] for g in got[i] if g[0] == name] == [matched]
    for i, (name, text) in enumerate(short):
        n = len(license_scan.words(text))
        assert sorted(g for g in got[edits + i] if g[0] == name) == [(name, k * n, k * n + n, n) for k in range(4)]
