"""Literal cases of text scans, names, modes, command lines, digests, ranges, cores, runs, files and configurations."""

import fnmatch
import hashlib
import json
import random
import re
import shlex
import time

import pytest
from pyspark.sql import functions as F

from factgraph.operators import access, command_line, config_check, graph, intervals, points_to, presentation, program, review, rules, scope, sets, text
from factgraph.plans import analysis, combine
from factgraph.sources import files, runs
from test_analysis import Model, VARIABLES, assert_run, function, judged, site, touch, variable  # noqa: F401
from test_cases import elf


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


# ---- text

#: How comments are found, written down once more for the test: literals first, then comments.
COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|/\*[\s\S]*?\*/|//[^\n]*')


def stripped(source):
    return COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], source)


def test_comments_of_any_size(spark):
    rng = random.Random(4)
    sources = ["".join(rng.choices(['"', "'", "/*", "*/", "//", "\\", "\n", "a", " ", "don't", "x = 1;", "\r\n"], k=rng.randint(0, 40))) for _ in range(400)]
    sources += ['s = "' + "x" * 1_000_000 + '"; /* gone */', "#error don't\n" + "int a; // b\n" * 4000, "/*" + "y\n" * 300_000 + "*/z", '"' + "\\n" * 200_000 + '"', "'" * 3001]
    got = spark.createDataFrame(list(enumerate(sources)), "i int, s string").select("i", text.strip_comments(F.col("s")).alias("t")).collect()
    assert all(r.t == stripped(sources[r.i]) for r in got)


def test_directives_of_odd_lines(spark):
    rows = [("crlf", "#if A && \\\r\n B\r\n#endif\r\n"), ("tab", "#ifndef\tG\r\n#define\tG\t1\r\n#endif"), ("stray", "#endif\n#else\n#if A\nx\n#elif B\ny\n#endif\n#endif\n#elif Q\n#if C\nz\n#endif"), ("open", "#endif\n#if A\n#if B\n#endif")]
    d = text.directives(spark.createDataFrame(rows, "file string, text string"))
    assert {(r.start, r.end, r.cmd, r.expr) for r in d.where("file = 'crlf'").collect()} == {(1, 2, "if", "A &&  B"), (3, 3, "endif", "")}
    arms = {(r.file, r.open, r.nth): (r.start, r.stop, r.guard) for r in text.conditional_branches(d).collect()}
    assert arms == {("crlf", 1, 1): (1, 2, False), ("tab", 1, 1): (1, 2, True), ("stray", 3, 1): (3, 4, False), ("stray", 3, 2): (5, 6, False), ("stray", 10, 1): (10, 11, False), ("open", None, None): (None, None, None)}
    f = spark.createDataFrame([("c", "#if A\r\nx\r\n#else\r\ny\r\n#endif\r\n")], "file string, text string")
    d = text.directives(f)
    assert sorted(r.text for r in text.branch_variants(f, d, text.conditional_branches(d)).collect()) == ["#if 0\r\nx\r\n#else\r\ny\r\n#endif\r\n", "#if 1\r\nx\r\n#else\r\ny\r\n#endif\r\n"]


def test_directives_do_not_shuffle_lines(spark):
    """every line went through two windows by file; a file's lines are folded where they are."""
    rows = spark.createDataFrame([("a", "#if A \\\n  && \\ \r\n B\nint a;\n#endif"), ("b", "x\n#define M \\\n"), ("c", "#define Z \\"), ("null", None)], "file string, text string")
    d = text.directives(rows)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in d.collect()) == [("a", 1, 3, "if", "A   &&  B"), ("a", 5, 5, "endif", ""), ("b", 2, 3, "define", "M"), ("c", 1, 1, "define", "Z")]


@pytest.mark.parametrize("given, want", [
    ("甲。乙；丙(a]b。c)丁", ["甲。", "乙；", "丙(a]b。c)丁"]), (" 一;二\n\n三【x。y】 ", ["一;二", "三【x。", "y】"]), ("（a(b。)c。）d。e", ["（a(b。)c。）d。", "e"]), ("", []), ("。。", ["。", "。"]), (None, None)])
def test_paragraphs(spark, given, want):
    assert one(spark, given).select(text.paragraphs(F.col("v"))).first()[0] == want


@pytest.mark.parametrize("given, want", [
    ("开始 (1) 先读。（优先级 7）(2)再写 ③ 完", [(None, "开始"), ("(1)", "先读。（优先级 7）"), ("(2)", "再写"), ("③", "完")]), ("1) a 2) b", [("1)", "a"), ("2)", "b")]), ("see 2.1) and x1) only", [(None, "see 2.1) and x1) only")]),
    ("(H+1) one (1) step", [(None, "(H+1) one (1) step")]), ("", []), ("f(1) g [ (2) ] 3) h", [(None, "f"), ("(1)", "g [ (2) ]"), ("3)", "h")])])
def test_numbered_steps(spark, given, want):
    assert [tuple(r) for r in one(spark, given).select(F.inline(text.numbered_steps(F.col("v")))).collect()] == want


def test_long_texts_are_cut_in_one_pass(spark):
    """a text was cut anew for every character or sentence of it."""
    n = 20_000
    rows = spark.createDataFrame([("".join(f"句{i}(a。b)。 " for i in range(n)), "".join(f"③ 步{i} [2) x] " for i in range(n)), "2" * 300_000 + "1) a 2) b")], "prose string, steps string, digits string")
    began = time.time()
    r = rows.select(text.paragraphs("prose").alias("p"), text.numbered_steps("steps").alias("s"), text.numbered_steps("digits").alias("d")).first()
    assert time.time() - began < 60
    assert r.p == [f"句{i}(a。b)。" for i in range(n)] and [tuple(x) for x in r.s] == [("③", f"步{i} [2) x]") for i in range(n)] and len(r.d) == 1


def test_globs_match_as_shell_patterns(spark):
    patterns = ["a[[]0].c", "[^x]y", "[!x]y", "a?[b-d]*", "[a&&b]", "x[]y]z", "[~|]", "n.c", "[\\]"]
    names = ["a[0].c", "^y", "xy", "zy", "aqc1", "&", "a", "x]z", "xyz", "|", "n.c", "nxc", "\\", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    for p in patterns:
        assert {r.n for r in rows.where(F.rlike("n", F.lit(scope.glob_regex(p)))).collect()} == {n for n in names if fnmatch.fnmatchcase(n, p)}, p


# ---- syntax

def modes(spark, chains, **kw):
    rows = []
    for ref, chain in chains.items():
        for i, step in enumerate(chain):
            kind, more = (step, {}) if isinstance(step, str) else step
            d = dict(op=None, child=0, same_symbol=False, is_array=False, decays=False, arrow=False, name=None) | more
            rows.append((ref, i + 1, kind, *(d[c] for c in ("op", "child", "same_symbol", "is_array", "decays", "arrow", "name"))))
    return spark.createDataFrame(rows, "ref string, distance int, kind string, op string, child int, same_symbol boolean, is_array boolean, decays boolean, arrow boolean, name string")


def test_access_modes_and_paths(spark):
    assign, inc, addr_of, star = ("BINARY", dict(op="=")), ("UNARY", dict(op="++")), ("UNARY", dict(op="&")), ("UNARY", dict(op="*"))
    m = lambda n, **k: ("MEMBER", dict(name=n, **k))
    decay = ("WRAPPER", dict(decays=True))
    cases = {
        "a = 1": ([assign], "WRITE", ""), "s.f = 1": ([m("f"), assign], "WRITE", "f"), "s.f.g++": ([m("f"), m("g"), inc], "RMW", "g.f"), "a[i] = 1, a": ([decay, "SUBSCRIPT", assign], "WRITE", "[]"), "a[i] = 1, i": ["WRAPPER", ("SUBSCRIPT", dict(child=1)), assign], "*p = 1": ([star, assign], "READ", ""),
        "s->f = 1": ([m("f", arrow=True), assign], "READ", ""), "a = a + 1": ([("BINARY", dict(op="=", same_symbol=True))], "RMW", ""), "x = a": ([("BINARY", dict(op="=", child=1))], "READ", ""), "p = &a": ([addr_of, ("BINARY", dict(op="=", child=1))], "ADDRESS_TAKEN", ""), "p = arr": ([decay, ("BINARY", dict(op="=", child=1))], "ADDRESS_TAKEN", ""),
        "f(arr)": ([("CALL", dict(is_array=True))], "ADDRESS_TAKEN", ""), "f(arr.x)": ([m("x"), ("CALL", dict(is_array=True))], "READ", "x"), "sizeof a": (["SIZEOF"], None, ""), "return a": (["RETURN"], "READ", ""), "a |= 1": ([("BINARY", dict(op="|="))], "RMW", ""), "-a": ([("UNARY", dict(op="-"))], "READ", ""), "arr[0].f": ([decay, "SUBSCRIPT", m("f"), "RETURN"], "READ", "f.[]"),
    }
    cases["a[i] = 1, i"] = (cases["a[i] = 1, i"], "READ", "")
    got = {r.ref: (r.mode, r.path) for r in access.access_mode(modes(spark, {k: v[0] for k, v in cases.items()})).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}
    through = {r.ref: r.mode for r in access.access_mode(modes(spark, {"p.f = 1": [m("f"), assign], "p = 1": [assign]}), through_pointer=True).collect()}
    assert through == {"p.f = 1": "READ", "p = 1": "WRITE"}
    places = {"*p = 1": [assign], "p->f++": [m("f", arrow=True), inc], "&p[0]": ["SUBSCRIPT", addr_of], "x = *p": [("BINARY", dict(op="=", child=1))], "*p += 1": [("BINARY", dict(op="+="))], "sizeof *p": ["WRAPPER", "SIZEOF"], "f(*p)": ["CALL"], "**p": [star]}
    assert {r.ref: r.mode for r in access.indirect_mode(modes(spark, places)).collect()} == {"*p = 1": "WRITE", "p->f++": "RMW", "&p[0]": "ADDRESS_TAKEN", "x = *p": "READ", "*p += 1": "RMW", "sizeof *p": None, "f(*p)": "READ", "**p": "READ"}


def test_operator_kinds(spark):
    rows = spark.createDataFrame([(1, True), (5, True), (6, True), (22, False), (26, False), (33, False), (10, False), (99, True)], "k int, u boolean")
    assert [r[0] for r in rows.select(access.operator_text(F.col("k"), F.col("u"))).collect()] == ["++", "&", "*", "=", "+=", ",", "", ""]


# ---- command lines

def test_words_as_a_shell_splits_them(spark):
    rng = random.Random(8)
    commands = ["".join(rng.choices(['"', "'", "\\", " ", "\t", "\n", "a", "-D", "x=1", "é", "#", "$", "*"], k=rng.randint(0, 14))) for _ in range(1500)] + ["", " ", "''", '""', "a'b c'\"d e\"f\\ g", '"' + "q " * 100_000 + '"']
    got = {r.i: r.w for r in spark.createDataFrame(list(enumerate(commands)), "i int, c string").select("i", command_line.words(F.col("c")).alias("w")).collect()}
    for i, c in enumerate(commands):
        try:
            want = shlex.split(c)
        except ValueError:
            want = None
        assert got[i] == want, c


def test_response_files_and_arguments(spark):
    deep = [(f"/w/d{i}.rsp", f"@d{i + 1}.rsp") for i in range(22)] + [("/w/d22.rsp", "-DDEEP")]
    listed = spark.createDataFrame([("/w/a.rsp", "﻿-DA @b.rsp 'x y'\n-DB"), ("/w/b.rsp", "-I\"inc dir\""), ("/w/loop.rsp", "-DL @sub/../loop.rsp"), ("/w/bad.rsp", '"open'), ("/w/none.rsp", ""), *deep], "path string, content string")
    entries = [("a", "s.c", "/w", "ccache gcc -c @a.rsp -o out.o s.c -DC", None), ("list", "/w/s.c", "/w", None, ["/x/arm-none-eabi-gcc.exe", "-MF", "dep", "-ofile", "-DQ=1", "./s.c", "-g", "t.c"]), ("loop", "s.c", "/w", "gcc @loop.rsp", None), ("missing", "s.c", "/w", "gcc @zz.rsp", None), ("bad", "s.c", "/w", "gcc @bad.rsp", None),
               ("quote", "s.c", "/w", "gcc 'x", None), ("empty", "s.c", "/w", " ", None), ("null", "s.c", "/w", None, None), ("nothing", "s.c", "/w", "gcc @none.rsp -DX", None), ("deep", "s.c", "/w", "gcc @d0.rsp", None), ("fits", "s.c", "/w", "gcc @d2.rsp", None), ("target", "s.c", "/w", "arm-none-eabi-gcc --target=other s.c", None)]
    got = {r.tu: r for r in command_line.normalised(spark.createDataFrame(entries, "tu string, file string, directory string, command string, arguments array<string>"), listed, ["-Wall"], ["-g"]).collect()}
    assert got["a"].arguments == ["-DA", "-Iinc dir", "x y", "-DB", "-DC", "-Wall"] and got["a"].removed_arguments == ["-c", "-o", "out.o", "s.c"] and got["a"].response_files == ["/w/a.rsp", "/w/b.rsp"] and got["a"].source == "/w/s.c"
    assert got["list"].arguments == ["-DQ=1", "t.c", "--target=arm-none-eabi", "-Wall"] and got["list"].removed_arguments == ["-MF", "dep", "-ofile", "./s.c", "-g"] and got["list"].target == "arm-none-eabi"
    assert {k: r.problem for k, r in got.items() if r.problem} == {"loop": "CYCLE", "missing": "MISSING", "bad": "QUOTE", "quote": "QUOTE", "empty": "EMPTY", "null": "EMPTY", "deep": "TOO_DEEP"}
    assert got["nothing"].arguments == ["-DX", "-Wall"] and got["fits"].arguments == ["-DDEEP", "-Wall"] and got["target"].target is None and got["loop"].arguments is None
    empty = command_line.normalised(spark.createDataFrame([], "tu string, file string, directory string, command string, arguments array<string>"), listed)
    assert empty.count() == 0


# ---- digests

def test_canonical_digests_are_those_of_json(spark):
    kind = "n long, s string, b boolean, o struct<z:string,a:array<string>,m:map<string,int>>, l array<struct<k:string,v:int>>"
    rows = [(1, 'q"\\\n\t\r\b\f\x00\x1f/é😀', True, ("z", ["b", None], {"y": 1, "ä": None}), [("k", 1), None]), (None, None, None, None, None), (-5, "", False, (None, [], {}), [])]
    df = spark.createDataFrame(rows, kind)
    plain = lambda r: dict(n=r[0], s=r[1], b=r[2], o=r[3] and dict(z=r[3][0], a=r[3][1], m=r[3][2]), l=None if r[4] is None else [x and dict(k=x[0], v=x[1]) for x in r[4]])
    want = [hashlib.sha256(json.dumps(plain(r), sort_keys=True, ensure_ascii=False).encode()).hexdigest() for r in rows]
    assert [r.digest for r in sets.canonical_digest(df, df.columns).collect()] == want
    assert sets.dedup_canonical(df.union(df)).count() == 3
    with pytest.raises(TypeError, match="double"):
        sets.canonical_digest(one(spark, 1.5, "double"), ["v"])


# ---- ranges and graphs

def test_points_in_ranges_of_one_file(spark):
    rng = random.Random(3)
    ranges = [(f"f{i}", "a.c", lo, lo + rng.choice([0, 5, 80, 3000, 900_000])) for i in range(300) for lo in [rng.randrange(1_000_000)]] + [("empty", "a.c", 9, 3), ("null", "a.c", None, 4), ("big", "b.c", -(10**12), 10**12)]
    points = [(i, "a.c" if i % 9 else "b.c", rng.randrange(1_100_000)) for i in range(400)] + [(999, "a.c", None)]
    r, p = spark.createDataFrame(ranges, "id string, file string, low long, high long"), spark.createDataFrame(points, "n int, file string, at long")
    got = sorted((x.n, x.id) for x in intervals.points_in_ranges(p, r, ["file"], "at", "low", "high").collect())
    assert got == sorted((n, i) for n, f, at in points for i, g, lo, hi in ranges if f == g and None not in (at, lo, hi) and lo <= at <= hi)
    n = 100_000  # one file, one function in every ten lines
    many = spark.range(n).select(F.concat(F.lit("f"), "id").alias("function_id"), F.lit("x.c").alias("file"), (F.col("id") * 10).alias("line"), (F.col("id") * 10 + 8).alias("end_line"))
    began = time.time()
    assert access.macro_owner(spark.range(n).select("id", (F.col("id") * 10 + 3).alias("pos"), F.lit("x.c").alias("file")).withColumnRenamed("id", "site"), many).count() == n
    assert time.time() - began < 60


def test_graphs_against_plain_search(spark):
    rng = random.Random(11)
    edges = {(f"f{rng.randrange(25)}", f"f{rng.randrange(25)}") for _ in range(45)} | {(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)} | {(f"k{i}", f"k{i + 1}") for i in range(30)} | {("c3", "z1"), ("s", "s")}
    seeds = [("A", "f0"), ("A", "f3"), ("B", "k0"), ("B", "k2"), ("C", "c4"), ("D", "nowhere")]
    e, s = spark.createDataFrame(sorted(edges), "caller string, callee string"), spark.createDataFrame(seeds, "context_id string, function_id string")
    best = {}
    for label in "ABCD":
        level = {f: (f,) for a, f in seeds if a == label}
        while level:
            best |= {(label, f): p for f, p in level.items()}
            after = {}
            for a, b in edges:
                if a in level and (label, b) not in best:
                    after[b] = min(after.get(b, level[a] + (b,)), level[a] + (b,))
            level = after
    assert {(r.context_id, r.function_id): tuple(r.path) for r in graph.witness_paths(s, e).collect()} == best
    assert {(r.context_id, r.function_id): r.depth for r in graph.closure(s, e, "context_id").collect()} == {k: len(p) - 1 for k, p in best.items()}
    assert sorted(tuple(r) for r in graph.reach_sets(s, e, "context_id", bits=3).collect()) == sorted(best)
    below = {}
    for start in {x for edge in edges for x in edge}:
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            new = {b for a, b in edges if a == at} - seen
            seen |= new
            todo += new
        below[start] = seen
    assert {tuple(r) for r in graph.cyclic_edges(e).collect()} == {(a, b) for a, b in edges if a in below[b]}


def test_a_chain_of_two_thousand(spark):
    n, chain = 2000, spark.range(2000).select(F.format_string("f%05d", "id").alias("caller"), F.format_string("f%05d", F.col("id") + 1).alias("callee"))
    seeds = spark.createDataFrame([("x", "f00000"), ("y", "f01000")], "context_id string, function_id string")
    began = time.time()
    got = graph.closure(seeds, chain, "context_id").groupBy("context_id").agg(F.count("*"), F.max("depth")).collect()
    assert {tuple(r) for r in got} == {("x", n + 1, n), ("y", n - 999, n - 1000)}
    assert graph.reach_sets(seeds, chain, "context_id").count() == 2 * n - 998
    took = time.time() - began
    assert graph.cyclic_edges(chain).count() == 0 and graph.cyclic_edges(chain.union(chain.limit(1).select(F.lit("f02000"), F.lit("f00000")))).count() == n + 1
    assert took < 60


# ---- several cores

def test_two_cores_as_one(spark):
    def core(name, fn_kind, accesses):
        return {
            "variables": [variable("g", definition_file="d/a.c"), variable("own")], "functions": [function("main"), function("cb")], "accesses": accesses, "calls": [dict(caller="main", callee="cb", callee_name="cb", call_kind="DIRECT", file="a.c", line=1), dict(caller="cb", callee="lib", callee_name="lib", call_kind="DIRECT", file="a.c", line=2)],
            "unknowns": [dict(kind="EXTERNAL_CALLEE", symbol_id=None, function_id="cb", target_function_id=None, file="a.c", line=2), dict(kind="ADDRESS_ESCAPE", symbol_id="own", function_id="main", target_function_id=None, file="a.c", line=5)],
            "protection_events": [], "snapshots": [dict(symbol_id="g", function_id="main")], "contexts": [dict(context_id="M", kind=fn_kind, reentrant=False, discovery="configured")], "roots": [dict(context_id="M", function_id="main")]}

    schemas = analysis.TABLES | {"variables": VARIABLES, "contexts": "context_id string, kind string, reentrant boolean, discovery string", "roots": "context_id string, function_id string"}
    frames = lambda t: {k: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schemas[k].split(", ")) for r in t[k]], schemas[k]) for k in combine.TABLES}
    objects = spark.createDataFrame([("g", 0x2000, 8, 1, "a.c"), ("own", 0x9000, 4, 1, "a.c")], "name string, address long, size long, binding int, file string")
    a, b = core("a", "TASK", [touch("g", "main", "WRITE"), touch("own", "cb", "READ")]), core("b", "MAIN", [touch("g", "cb", "RMW")])

    def run(cores):
        made = combine.Combined(spark, {"a": combine.Variant(cores[0], frames(a), objects), "b": combine.Variant(cores[1], frames(b), objects)}, [(0x2000, 8)])
        return made, {r.symbol_id: list(r.rules) for r in made.findings().collect()}

    made, rules = run(("m7", "m4"))
    assert {(r.combined_id, r.variant, r.core) for r in made.instances().where("symbol_id = 'g'").collect()} == {("shared:0x2000:8", "a", "m7"), ("shared:0x2000:8", "b", "m4")}
    assert {"GS-CROSS-CORE", "GS-MULTI-WRITER", "GS-MULTI-CONTEXT", "GS-STALE-SNAPSHOT"} <= set(rules["shared:0x2000:8"]) and "a::own" in rules and "GS-CROSS-CORE" not in rules["a::own"]
    assert {(r.caller, r.callee) for r in made.run.edges.collect()} == {("a::main", "a::cb"), ("b::main", "b::cb")} and {r.context_id for r in made.run.contexts.collect()} == {"a:M", "b:M"}
    assert made.run.unknowns.where("kind = 'EXTERNAL_CALLEE'").count() == 2
    _, rules = run(("m7", "m7"))
    assert "GS-CROSS-CORE" not in rules["shared:0x2000:8"] and "GS-MULTI-WRITER" in rules["shared:0x2000:8"]


def test_ids_at_any_depth(spark):
    df = spark.createDataFrame([("g", "main", [("own", [("g", "cb")])], {"k": ("g", None)}, "main"), (None, "", None, None, None)], "symbol_id string, function_id string, l array<struct<symbol_id:string,in:array<struct<symbol_id:string,callee:string>>>>, m map<string,struct<symbol_id:string,context_id:string>>, note string")
    ids = spark.createDataFrame([("g", "shared:0x1:4")], "symbol_id string, combined_id string")
    got = [r.asDict(recursive=True) for r in combine.renamed(df, "v", ids).collect()]
    assert got == [dict(symbol_id="shared:0x1:4", function_id="v::main", l=[{"symbol_id": "v::own", "in": [dict(symbol_id="shared:0x1:4", callee="v::cb")]}], m={"k": dict(symbol_id="shared:0x1:4", context_id=None)}, note="main"), dict(symbol_id=None, function_id="", l=None, m=None, note=None)]


# ---- runs, files, configurations

def test_runs_are_published_whole(spark, tmp_path):
    store, df = runs.RunStore(spark, f"{tmp_path}/store"), spark.createDataFrame([("f1", [1, 2])], "finding_id string, n array<int>")
    with pytest.raises(ValueError, match="no published run"):
        store.read("findings")
    first = store.start()
    store.publish(first, {"findings": df}, config="c1")
    second = store.start()
    with pytest.raises(Exception, match="broken"):
        store.publish(second, {"findings": df.union(df), "bad": df.select(F.raise_error(F.lit("broken")).alias("x"))})
    assert store.runs() == [first] and list(store.failures()) == [second] and store.read("findings").collect() == df.collect() and store.manifest(first)["facts"] == {"config": "c1"}
    with pytest.raises(ValueError, match="not published"):
        store.read("findings", second)
    third = store.start()
    store.publish(third, {"findings": df.union(df)})
    assert store.read("findings").count() == 2 and store.read("findings", first).count() == 1
    df.write.mode("append").parquet(f"{store.folder(third)}/findings")
    with pytest.raises(ValueError, match="not what was published"):
        store.read("findings")
    event = lambda f, seq, p, state, status: spark.createDataFrame([(f, seq, p, state, status)], "finding_id string, seq long, pass int, state string, status string")
    assert store.events().count() == 0
    for run, e in ((first, event("f1", 1, 0, "FAILED", "NEED_MORE_CONTEXT")), (first, event("f1", 2, 0, "DONE", "CONFIRMED")), (third, event("f1", 1, 1, "DONE", "REVIEWED_SAFE")), (third, event("f2", 1, 0, "DONE", "REVIEWED_SAFE"))):
        store.add_events(run, e)
    history = [(r.place, r["pass"], r.state, r.last_of_pass) for r in runs.review_history(store.events()).where("finding_id = 'f1'").orderBy("place").collect()]
    assert history == [(1, 0, "FAILED", False), (2, 0, "DONE", True), (3, 1, "DONE", True)]
    known = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "finding_id string")
    states = lambda both: {r.finding_id: (r.state, r.status) for r in runs.review_states(known, store.events(), both).collect()}
    assert states(True) == {"f1": ("DONE", "REVIEWED_SAFE"), "f2": ("AUDIT_PENDING", "NEED_MORE_CONTEXT"), "f3": ("PENDING", "NEED_MORE_CONTEXT")} and states(False)["f2"] == ("DONE", "REVIEWED_SAFE")


def test_json_replaces_only_when_whole(spark, tmp_path):
    df, path = spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/out"
    files.write_json(df, path)
    with pytest.raises(Exception, match="broken"):
        files.write_json(df.select(F.raise_error(F.lit("broken")).alias("x")), path)
    assert spark.read.json(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["out"]
    files.write_json(df.union(df), path)
    assert spark.read.json(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="broken"):
        files.write_sqlite({"t": df.select(F.raise_error(F.lit("broken")).alias("x"))}, f"{tmp_path}/x.db")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_sources_of_a_project(spark, tmp_path):
    for name in ("a/compile_commands.json", "a/.git/compile_commands.json", "node_modules/x/compile_commands.json", "a/b/x.c", "a/b/y.H"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("[]")
    assert {r.file for r in files.list_files(spark, str(tmp_path), ["*.c", "*.H"]).collect()} == {"a/b/x.c", "a/b/y.H"}
    assert files.discover_database(spark, str(tmp_path)).endswith("/a/compile_commands.json")
    with pytest.raises(ValueError, match="no compile_commands"):
        files.discover_database(spark, str(tmp_path / "a/b"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b/compile_commands.json").write_text("[]")
    with pytest.raises(ValueError, match="several"):
        files.discover_database(spark, str(tmp_path))
    (tmp_path / "a/m7.elf").write_bytes(elf())
    assert {r.name for r in files.scan_images(spark, str(tmp_path)).where("type = 1 and defined and size > 0").collect()} == {"shared"}


CONFIG = dict(version=1, contexts=[dict(id="a", kind="ISR"), dict(id="b", kind="TASK", functions=["f"], regex=["x(.*)y"])])


def entry(**more):
    return dict(api="r*", callback_arg=0, kind="ISR") | more


@pytest.fixture(scope="module")
def violations(spark):
    cases = [
        (CONFIG, set()), ({}, {("$", "NOT_A_VERSION_1_MAPPING")}), ([1], {("$", "NOT_A_VERSION_1_MAPPING")}), (dict(version=1), set()), (dict(CONFIG, project=[]), {("$.project", "NOT_A_MAPPING")}), (dict(CONFIG, resources=[1]), {("$.resources", "NOT_A_LIST_OF_MAPPINGS")}), (dict(CONFIG, project=dict(root=" ")), {("$.project.root", "EMPTY")}),
        (dict(version=1, contexts=[dict(id="a", kind="X"), dict(id="a", kind="ISR", enabled="yes", regex=["(x"]), dict(kind="ISR", functions="f", patterns=[1])]), {("$.contexts[0]", "UNKNOWN_KIND"), ("$.contexts[1]", "ID_TWICE"), ("$.contexts[1]", "ENABLED_NOT_A_FLAG"), ("$.contexts[1]", "REGEX_INVALID"), ("$.contexts[2]", "ID_MISSING"), ("$.contexts[2]", "FUNCTIONS_NOT_TEXTS"), ("$.contexts[2]", "PATTERNS_NOT_TEXTS")}),
        (dict(CONFIG, concurrency=[dict(contexts=["a", "c"]), dict(contexts=["a", "b"], relation="never"), dict(contexts=["a", "b"])], preemption=[dict(higher="a", lower="z"), dict(higher="a", lower="b")]), {("$.concurrency[0]", "NOT_TWO_CONTEXTS"), ("$.concurrency[1]", "UNKNOWN_RELATION"), ("$.preemption[0]", "UNKNOWN_CONTEXT")}),
        (dict(CONFIG, entry_registrations=[entry(context_id="a"), entry(context_id="b"), entry(api=" ", callback_arg=-1, kind="MAIN", zz=1, may_repeat=1, context_id=""), entry(context_id="n"), entry(kind="TASK", context_id="n", callback_arg=True)]),
         {("$.entry_registrations[1]", "CONTEXT_KIND_CONFLICT"), *(("$.entry_registrations[2]", p) for p in ("UNKNOWN_FIELD", "API_EMPTY", "CALLBACK_ARG", "UNKNOWN_KIND", "CONTEXT_ID_EMPTY", "MAY_REPEAT_NOT_A_FLAG")), ("$.entry_registrations[4]", "CONTEXT_KIND_CONFLICT"), ("$.entry_registrations[4]", "CALLBACK_ARG")}),
        (dict(CONFIG, analysis=dict(extra_args="x", include_dirs=["src", "a*"], cmake=dict(build="yes", zz=1, args=[1], build_dir="", timeout_seconds=0), cmake_args=["x"], auto_contexts=1, parse_timeout_seconds=-1)),
         {("$.analysis.extra_args", "NOT_TEXTS"), ("$.analysis.include_dirs", "NOT_A_PATH"), ("$.analysis.cmake", "UNKNOWN_FIELD"), ("$.analysis.cmake", "OLD_FIELDS_TOO"), ("$.analysis.cmake.build", "NOT_A_FLAG"), ("$.analysis.cmake.args", "NOT_TEXTS"), ("$.analysis.cmake.build_dir", "EMPTY"), ("$.analysis.cmake.timeout_seconds", "NOT_POSITIVE"), ("$.analysis.auto_contexts", "NOT_A_FLAG"), ("$.analysis.parse_timeout_seconds", "NOT_POSITIVE")}),
        (dict(CONFIG, review=dict(workers=9, retries=-1, max_items=1.5, command=[], enabled="no", timeout_seconds="x"), project=dict(native_word_bits=12), api_patterns=dict(lock_enter=["a*"], lock_exit="b")),
         {("$.review.workers", "NOT_1_TO_8"), ("$.review.retries", "NOT_A_COUNT"), ("$.review.max_items", "NOT_A_COUNT"), ("$.review.command", "NOT_A_LIST_OF_ARGUMENTS"), ("$.review.enabled", "NOT_A_FLAG"), ("$.review.timeout_seconds", "NOT_POSITIVE"), ("$.project.native_word_bits", "NOT_A_MULTIPLE_OF_8"), ("$.api_patterns.lock_exit", "NOT_TEXTS")})]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(len(cases), "no json"), (len(cases) + 1, None)], "config_id int, config string")
    got = {}
    for r in config_check.config_violations(df).collect():
        got.setdefault(r.config_id, set()).add((r.path, r.problem))
    return [(c, want, got.get(i, set())) for i, (c, want) in enumerate([*cases, ("no json", {("$", "NOT_A_VERSION_1_MAPPING")}), (None, {("$", "NOT_A_VERSION_1_MAPPING")})])]


@pytest.mark.parametrize("case", range(14))
def test_configurations(violations, case):
    config, want, got = violations[case]
    assert got == want, config


def test_investigations_with_null_references(spark):
    rows = spark.createDataFrame([("f", "a", "ok", None), ("f", "b", "ok", [1]), ("g", "a", "ok", [1]), ("f", "c", "ok", [None])], "finding_id string, id string, assessment string, refs array<int>")
    required = rows.select("finding_id", "id")
    answers = spark.createDataFrame([("f", "CONFIRMED", 1)], "finding_id string, status string, n_evidence int")
    assert {tuple(r) for r in review.investigation_check(rows, required, answers).collect()} == {("f", "a", "BAD_REF"), ("g", "a", "NO_ANSWER"), ("f", "c", "BAD_REF")}


def test_presentation(spark):
    rows = spark.createDataFrame([("a|b\nc", "x.c", 3), (None, "", 0), ("", None, None)], "v string, file string, line int")
    assert [tuple(r) for r in rows.select(presentation.cell(F.col("v")), presentation.place(F.col("file"), F.col("line"))).collect()] == [("a\\|b c", "x.c:3"), ("—", "未知:?"), ("", "未知:?")]
    entries = spark.createDataFrame([("g", "t", "TASK", 1), ("g", "m", "MAIN", 9), ("g", "u", "TASK", 1), ("g", "n", "ISR", None), ("h", "i", "ISR", 2)], "symbol_id string, context_id string, kind string, distance int")
    assert {r.symbol_id: (r.entries, r.n_more) for r in presentation.first_entries(entries).collect()} == {"g": (["m", "t"], 2), "h": (["i"], 0)}


def test_a_leak_stops_the_output(spark):
    s = scope.Scope(["App"])
    v = spark.createDataFrame([("in", "App/a.c", None), ("out", "Lib/b.c", None)], "symbol_id string, definition_file string, declaration_file string")
    found = spark.createDataFrame([("f1", "in"), ("gap", None)], "finding_id string, symbol_id string")
    assert {r.finding_id for r in scope.closed(found, v, s).collect()} == {"f1", "gap"}
    for leak in ("out", "unknown"):
        with pytest.raises(Exception, match="out of scope: f2"):
            scope.closed(found.union(spark.createDataFrame([("f2", leak)], found.schema)), v, s).collect()


def test_configuration_is_read_once(spark):
    """All rules of a configuration are judged in its row; places and order within it decide, not joins of its sections."""
    text = json.dumps({"version": 1, "contexts": ["no mapping", {"id": "a", "kind": "ISR"}, {"id": " "}, {"id": "a", "kind": "TASK"}], "preemption": [{"higher": "a", "lower": "b"}],
                       "entry_registrations": [7, {"api": "r", "callback_arg": 0, "kind": "TASK", "context_id": "a"}, {"api": "r", "callback_arg": 0, "kind": "ISR", "context_id": "a"}, {"api": "r", "callback_arg": 0, "kind": "ISR", "context_id": "new"}], "api_patterns": {"k.x": ["p"], "m": "p"}})
    found = config_check.config_violations(spark.createDataFrame([(1, text), (2, None)], "config_id int, config string"))
    assert {(r.config_id, r.path, r.problem) for r in found.collect()} == {
        (1, "$.contexts", "NOT_A_LIST_OF_MAPPINGS"), (1, "$.entry_registrations", "NOT_A_LIST_OF_MAPPINGS"), (1, "$.contexts[2]", "ID_MISSING"), (1, "$.contexts[2]", "UNKNOWN_KIND"), (1, "$.contexts[3]", "ID_TWICE"), (1, "$.preemption[0]", "UNKNOWN_CONTEXT"),
        (1, "$.entry_registrations[2]", "CONTEXT_KIND_CONFLICT"), (1, "$.api_patterns.m", "NOT_TEXTS"), (2, "$", "NOT_A_VERSION_1_MAPPING")}
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_equal_trees_are_one_expression(spark):
    """Instructions grow with calls and with different trees, not with the places that have a tree."""
    tree, fn = json.dumps({"op": "addr", "value": {"op": "loc", "id": "obj:P1"}}), json.dumps({"op": "function", "id": "F1"})
    calls = spark.createDataFrame([(i, "F0", "call", None if i % 2 else "F1", fn if i % 2 else None, [tree, None], tree, "a.c", 1, i) for i in range(40)], analysis.TABLES["semantic_calls"])
    of = lambda name: spark.createDataFrame([], analysis.TABLES[name])
    made = program.instructions(of("constraints"), calls, of("indirect_accesses"))
    assert {r["op"]: r["count"] for r in made.groupBy("op").count().collect()} == {"ADDR": 1, "LOC": 1, "READ": 1, "FUN": 1, "TARGET": 20, "CALLEE": 20, "ARG": 80, "RESULT": 40}
    found = points_to.solution(made)
    assert {(r.key, r.value) for r in found.members("T").collect()} == {(f"s:{i}", "F1") for i in range(40)}
    assert {(r.key, r.value) for r in found.rows("P").collect()} == {("F1:param:0", "obj:P1")}


def test_component_loops_broadcast_nothing(spark, monkeypatch):
    """Tables of the rounds do not go through the driver."""
    plans, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "caller string, callee string")
    assert {tuple(r) for r in graph.cyclic_edges(edges).collect()} == {("a", "b"), ("b", "a"), ("c", "c")}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_accesses_are_shuffled_once(spark):
    """Summing up by function takes one shuffle; ids of another core need none where few objects are shared; of rows with one id the greatest stays, and only those are grouped."""
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    columns = "access_id string, symbol_id string, function_id string, access_kind string, file string, line long, pos long, access_path string, via_alias boolean"
    rows = [("1", "s", "f", "READ", "a.c", 1, 1, "", False), ("1", "s", "f", "WRITE", "a.c", 1, 1, "", False), ("2", "s", "f", "READ", "a.c", 2, 2, "", False), ("3", "t", "g", "RMW", "b.c", 3, 3, "/x", True), (None, "t", "g", "READ", "b.c", 4, 4, "", False), (None, "t", "g", "READ", "b.c", 3, 4, "", False)]
    accesses = spark.createDataFrame(rows, columns)
    one = analysis.one_of_each(accesses)
    assert sorted(map(tuple, one.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4]], key=str)
    summed = rules.by_function(accesses)
    assert shuffles(summed) == 1
    assert sorted((r.symbol_id, r.function_id, r.n, r.sites, r.writes, r.rmw, r.escapes) for r in summed.collect()) == [("s", "f", 3, 3, True, False, False), ("t", "g", 3, 2, True, True, True)]
    ids = graph.checkpointed(spark.createDataFrame([("s", "shared:0x10:4")], "symbol_id string, combined_id string"))
    other = combine.renamed(accesses, "v", ids)
    assert shuffles(other) == 0
    assert sorted((r.access_id or "", r.symbol_id, r.function_id) for r in other.collect()) == [("", "v::t", "v::g"), ("", "v::t", "v::g"), ("v:1", "shared:0x10:4", "v::f"), ("v:1", "shared:0x10:4", "v::f"), ("v:2", "shared:0x10:4", "v::f"), ("v:3", "v::t", "v::g")]
