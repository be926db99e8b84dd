"""BPE, fill-in-middle and prefix trie against the library, brute force and SQL."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("factgraph.llm")
from factgraph.llm import bpe_lexicon, fill_middle, prefix_trie, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, ids string, n int"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "k", "x", 1) for i, t in enumerate(texts)], SCHEMA)


# ---- op11

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_model("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), json.load(f), path


PIECES = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "😀", "\x1c", "\x85", " ", "　", "1", "½", "Ⅷ", "<|endoftext|>", "<|endof", "!", "...", "́", "‍", "\x00", "the", " the", "Tion", "𝔘"]


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(4000)]
    return [*made, None, "", "a" * 200_000, "ab" * 50_000, " " * 30_000, "é" * 30_000, "<|endoftext|>" * 1000, made[0], made[0]]


def test_bpe_equals_library(spark, library):
    lib, _, path = library
    texts = odd_texts()
    got = {r.doc_id: r for r in bpe_lexicon.encode_decode(frame(spark, texts), path, share=1 << 12).collect()}
    full = {r.doc_id: r for r in bpe_lexicon.encode_decode(frame(spark, texts[:200]), path, "full").collect()}
    assert len(got) == len(texts)
    for i, e in enumerate(lib.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        decoded = lib.decode(e.ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(e.ids), sha(",".join(map(str, e.ids))), sha(decoded))
        if i in full:
            assert (list(full[i].ids), full[i].decoded) == (e.ids, decoded)


def test_bpe_every_character(library):
    """Classes of characters are the library's, whatever the Unicode version."""
    lib, spec, _ = library
    encoder = bpe_lexicon.Encoder(spec["model"], bpe_lexicon.word_patterns(lib.pre_tokenizer.pre_tokenize_str), {}, bpe_lexicon.compile_lexicon([]))
    texts = [f"a{c} {c}1{c}!{c}" for c in map(chr, range(0, 0x110000, 5)) if not 0xD800 <= ord(c) < 0xE000]
    assert encoder.run(texts)[0] == [",".join(map(str, e.ids)) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(2)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 8))) for _ in range(600)})
    outs = {w: tuple(rng.choices(range(9), k=rng.randint(1, 4))) for w in words}
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon((w, outs[w]) for w in words))
    asked = words + [bytes(rng.choices(b"abcd", k=rng.randint(0, 9))) for _ in range(2000)]
    there, ids, sizes = lexicon.find(asked)
    ends = np.cumsum(sizes)
    assert there.tolist() == [w in outs for w in asked]
    assert [tuple(ids[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)] == [outs.get(w, ()) for w in asked]
    # As few states as there are different continuations with the outputs that no longer agree before them.
    shared = sorted((a + b, (1, 2)) for a in (b"x", b"y", b"z") for b in (b"ing", b"ings", b"ed"))
    packed = bpe_lexicon.compile_lexicon(shared)
    assert packed[0] == 7  # start, after the first letter, i, in, ing, e, and the end of "ings" and "ed"


def test_frequent_words_are_bounded(spark):
    docs = frame(spark, ["one two two three three three " * 50, None, "rare " + "w" * 100])
    assert set(bpe_lexicon.frequent_words(docs, 4)) <= {" two", " three", "one", " one"}
    assert len(bpe_lexicon.frequent_words(docs, 4)) <= 4
    assert len(bpe_lexicon.frequent_words(docs, 1 << 18)) >= 3


def test_bpe_empty_table_and_null_ids(spark, library):
    assert bpe_lexicon.encode_decode(frame(spark, []), library[2]).count() == 0
    rows = bpe_lexicon.encode_decode(frame(spark, ["x", "x", None], [None, 2**62 + 1, 3]), library[2]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [(False, 3, 0), (False, 2**62 + 1, 1), (True, 0, 1)]


# ---- op12

def arranged(text, key, percent=100):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab\n<PSM>é😀\r", k=rng.choice([0, 1, 3, 10, 30, 9000 if i % 40 == 0 else 20]))) for i in range(800)]
    texts += [None, "", "\n", "\n\n", "x", "<P>", "a<S>\n", "line\n" * 50_000, "x" * 500_000, texts[5], texts[5]]
    want = {i: arranged(t or "", i) for i, t in enumerate(texts)}
    for r in fill_middle.fill_middle(frame(spark, texts), "full").collect():
        assert tuple(r)[1:] == (*want[r.doc_id], texts[r.doc_id] or "")
    for r in fill_middle.fill_middle(frame(spark, texts)).collect():
        n, form, p, m, output = want[r.doc_id]
        assert tuple(r)[1:] == (n, form, p, m, sha(output), sha(texts[r.doc_id] or ""))
    plain = [r.form for r in fill_middle.fill_middle(frame(spark, texts[:300]), fim_percent=30).collect()]
    assert plain == [arranged(t, i, 30)[1] for i, t in enumerate(texts[:300])]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 4096])
def test_rope_splits(leaf):
    text = "ab\n\né😀\nlast"
    rope = fill_middle.Rope.of(text, leaf)
    assert (str(rope), rope.chars, rope.ends, rope.lines()) == (text, len(text), 3, 4)
    for i in range(len(text) + 2):
        assert tuple(map(str, rope.split(i, "chars"))) == (text[:i], text[i:])
    for i, at in enumerate((0, 3, 4, 7, len(text))):
        assert tuple(map(str, rope.split(i, "ends"))) == (text[:at], text[at:])


def test_fill_middle_null_and_repeated_ids_and_empty_table(spark):
    rows = fill_middle.fill_middle(frame(spark, ["a\nb\n", "a\nb\n", "a\nb\n"], [None, 2**62 + 1, 2**62 + 1])).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["None", str(2**62 + 1), str(2**62 + 1)])
    assert {r.output_sha256 for r in rows if r.doc_id is None} == {sha(arranged("a\nb\n", "")[4])}
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0


# ---- op13

def turn_order(row):
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def brute_trie(rows):
    """Nodes of a trie of plain tuples."""
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(node)))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node], sha(ends)))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, key long, pos string, n int"


def conversation_rows(seed=1):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é😀"])) for c in [*range(260), -5, -105, -200, 2**62] for t in range(rng.choice([1, 2, 6, 9]))]
    rows += [(300, t, "user", "a") for t in range(3)] + [(310, None, "user", "a"), (310, None, "user", "b"), (310, 1, None, "b"), (310, 1, None, "b"), (None, 1, "user", "x")]
    return rows + [(c, t, "user", f"turn {t}") for c in range(400, 460) for t in range(12)] + [(777, t, "user", "x" * (t % 3)) for t in range(5000)] + [(778, t, "user", "x" * (t % 3)) for t in range(4500)]


def nodes(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def turns_frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], TURNS).repartition(parts)


def test_trie_equals_brute_force(spark):
    rows = conversation_rows()
    rows = [r for r in rows if r[0] is None or r[0] < 777 or r[0] > 778] + [r for r in rows if r[0] in (777, 778) and r[1] < 300]
    want = brute_trie(rows)
    assert nodes(prefix_trie.trie(turns_frame(spark, rows))) == want
    assert nodes(prefix_trie.trie(turns_frame(spark, rows), (7, 11))) == want  # nearly all fingerprints collide


def test_trie_of_long_conversations(spark):
    """Two conversations of several blocks of depths, over several tasks each."""
    rows = conversation_rows()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = nodes(prefix_trie.trie(turns_frame(spark, rows)))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)

    assert len(got) > 5000
    assert got == linear_trie(rows)


def linear_trie(rows):
    """As brute_trie, with nodes numbered instead of tuples of whole prefixes."""
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    child, parent, size, members, ends = {}, [None], [0], defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        at = 0
        members[0].append(c)
        for turn in own.get(base, [])[:h] + own[c][h:]:
            if (at, turn) not in child:
                child[at, turn] = len(parent)
                parent.append(at)
                size.append(len(turn[1]))
            at = child[at, turn]
            members[at].append(c)
        ends[at].append(c)
    n, depth = len(parent), [0] * len(parent)
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    kids, leaves, saved = [0] * n, [0] * n, [(len(members[v]) - 1) * size[v] for v in range(n)]
    for v in range(1, n):
        kids[parent[v]] += 1
    for v in range(n - 1, -1, -1):
        leaves[v] += not kids[v]
        if v:
            leaves[parent[v]] += leaves[v]
            saved[parent[v]] += saved[v]
    return {(min(members[v]), depth[v], min(members[parent[v]]) if v else None, len(members[v]), kids[v], leaves[v], saved[v], sha(",".join(map(str, sorted(ends[v]))))) for v in range(n)}


def test_trie_empty(spark):
    assert prefix_trie.trie(turns_frame(spark, [])).count() == 0
    assert prefix_trie.trie(turns_frame(spark, [(None, 1, "user", "x")])).count() == 0


# ---- the queries

@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(columns).collect())


def test_bpe_query_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op11_bpe(spark, SF).collect():
        ids = library[0].encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library[0].decode(ids, skip_special_tokens=False)))
    assert not texts
