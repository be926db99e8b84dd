"""Steps that must neither repeat a pass over the graph nor shuffle what lies in one row."""

import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from factgraph.operators import command_line, graph, points_to, program, text
from factgraph.plans import analysis, catalog

SF = "/root/testdata/sf0.001"
SOURCES = [
    ("a", "#ifndef A\n#define A\n#if X\nint a;\r\n# elif Y \\\n  && Z\r\nint b;\n#else\nint c;\n#endif\n#endif"), ("b", "#if X\n#ifdef Y\nint b;\n#endif\n#else\n#endif"), ("open", "#if X\nint a;"),
    ("stray", "#endif\n#else\n#ifdef A\n#endif\n#endif"), ("none", "int a;"), ("empty", ""), ("null", None), ("bare", "#ifndef\n#define\n#endif\n#if A\n/* #else */\n#endif"),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_branches_of_a_file_stay_in_its_row(spark):
    rng = random.Random(5)
    made = [(f"r{i}", "\n".join(rng.choice(["#if A", "#ifdef B", "#ifndef C", "#elif D", "#else", "#endif", "#endif", "#define C", "x"]) for _ in range(rng.randrange(1, 14)))) for i in range(200)]
    files = spark.createDataFrame(SOURCES + made, "file string, text string")
    found = text.directives(files)
    branches = text.file_branches(files)
    assert "Exchange" not in plan(branches) and "Exchange" not in plan(text.file_variants(files))
    assert sorted(map(str, branches.collect())) == sorted(map(str, text.conditional_branches(found).collect()))
    want = text.branch_variants(files, found, text.conditional_branches(found))
    got = text.file_variants(files).select(want.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) > 50
    arms = {(r.file, r.open, r.nth): (r.stop, r.parent, r.guard) for r in branches.where("file in ('a', 'b', 'open', 'stray', 'bare')").collect()}
    assert arms == {("a", 1, 1): (10, None, True), ("a", 3, 1): (4, 1, False), ("a", 3, 2): (7, 1, False), ("a", 3, 3): (9, 1, False), ("b", 1, 1): (4, None, False), ("b", 2, 1): (3, 1, False), ("b", 1, 2): (5, None, False),
                    ("open", None, None): (None, None, None), ("stray", 3, 1): (3, None, False), ("bare", 1, 1): (2, None, True), ("bare", 4, 1): (5, None, False)}


def test_rules_take_one_pass_along_the_calls(spark, monkeypatch):
    passes, whole = [], graph.spread_masks
    monkeypatch.setattr(graph, "spread_masks", lambda *a: passes.append(1) or whole(*a))
    assert catalog.BUILDS["findings_by_rule"](catalog.Facts(spark, SF)).count() > 0
    assert len(passes) == 1


def test_ancestors_are_followed_once_for_all_findings(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "c"), ("x", "y")], "caller string, callee string")
    seeds = spark.createDataFrame([(f"g{i}", f) for i in range(50) for f in ("c", "lone")] + [("h", "y"), ("h", "y"), ("h", "c")], "finding_id string, function_id string")
    followed, whole = [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda s, *a: followed.append(s.count()) or whole(s, *a))
    got = sorted(map(tuple, graph.ancestors_of_many(seeds, edges, "finding_id").collect()))
    assert got == sorted([(f"g{i}", f) for i in range(50) for f in ("a", "b", "c", "d", "lone")] + [("h", f) for f in ("a", "b", "c", "d", "x", "y")])
    assert followed == [3]


def test_words_of_units_stay_in_their_rows(spark, monkeypatch):
    rows = [(f"t{i}", "/w", ["gcc", "@r.rsp", "-a", "@/w/r.rsp"]) for i in range(20)] + [("none", None, ["x", "@no", "@/w/loop"]), ("plain", "/w", ["x", None, "y"]), ("loop", "/w", ["@loop", "@no"]), ("void", "/w", ["@void"]), ("empty", "/w", [])]
    files = spark.createDataFrame([("/w/r.rsp", "'p q' @s.rsp z"), ("/w/s.rsp", "deep"), ("/w/loop", "a @loop"), ("/w/void", " ")], "path string, content string")
    opened, whole = [], command_line._opened
    monkeypatch.setattr(command_line, "_opened", lambda a, f: opened.append(a.count()) or whole(a, f))
    args = spark.createDataFrame(rows, "tu string, directory string, arguments array<string>")
    got = {r.tu: (r.arguments, r.response_files, r.problem) for r in command_line.expand_responses(args, files).collect()}
    assert opened == [7]
    assert got == {r.tu: (r.arguments, r.response_files, r.problem) for r in whole(args, files).collect()}
    assert got["t3"] == (["gcc", "p q", "deep", "z", "-a", "p q", "deep", "z"], ["/w/r.rsp", "/w/s.rsp"], None) and got["loop"][2] == "CYCLE" and got["void"][0] == []


def test_brackets_decide_where_paragraphs_end(spark):
    """Texts of the query keep their brackets: fewer parts than without them, and as many as its SQL finds."""
    facts = catalog.Facts(spark, SF)
    parts = catalog.BUILDS["split_paragraphs"](facts).count()
    bare = F.expr(f"translate({catalog._PROSE}, '()[]{{}}（）', '')")
    without = facts.documents.select(F.explode(text.paragraphs(bare)))
    sql = catalog.SQL["split_paragraphs"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")
    assert 0 < parts < without.count() and len(duckdb.sql(sql).fetchall()) == parts


def tree(rng, depth=3):
    kind = rng.choice(["loc", "loc", "function", "none"] if depth == 0 else ["loc", "loc", "loc", "addr", "addr", "deref", "field", "union", "function", "odd"])
    below = lambda: tree(rng, depth - 1)
    return {"loc": lambda: {"op": "loc", "id": rng.choice(["a", "b", "c", "d", "e", "a/f", "F1:param:0", "F2:param:0", "F1:return", "F2:return", "x1", "x2", "x3", "x4"])}, "function": lambda: {"op": "function", "id": rng.choice(["F1", "F2", "F3"])},
            "addr": lambda: {"op": "addr", "value": below()}, "deref": lambda: {"op": "deref", "value": below()}, "field": lambda: {"op": "field", "base": below(), "field": rng.choice("fg")},
            "union": lambda: {"op": "union", "items": [below(), below()]}, "none": lambda: None, "odd": lambda: rng.choice([{"op": "loc"}, {"op": "addr", "value": "text"}, {"op": "deref"}, {"op": "new", "id": "a"}, {}])}[kind]()


def test_a_run_asks_less_of_pointers(spark):
    """What a run asks has the same answers as in the whole program, without instructions for direct calls or stores that nothing reads."""
    rng = random.Random(11)
    text_of = lambda t: None if t is None else json.dumps(t)
    constraints = [(i, text_of(tree(rng)), text_of(tree(rng))) for i in range(60)]
    calls = [(i, "F0", "call", rng.choice([None, "F1", "F2"]), text_of(tree(rng)), [text_of(tree(rng, 2)) for _ in range(rng.randrange(3))], text_of(tree(rng, 1)), "a.c", 1, i) for i in range(60)]
    items = [(i, "F0", text_of(tree(rng)), "READ", "a.c", 1, i) for i in range(40)]
    facts = {t: spark.createDataFrame(rows, analysis.TABLES[t]) for t, rows in (("constraints", constraints), ("semantic_calls", calls), ("indirect_accesses", items))}
    run = analysis.Run(spark, facts | {"variables": spark.createDataFrame([], "symbol_id string")}, analysis.Config(registrations=[{"api": "*", "callback_arg": 0, "kind": "TASK"}]))
    whole = points_to.solution(program.instructions(*(facts[t] for t in ("constraints", "semantic_calls", "indirect_accesses"))))
    rows = lambda df: sorted(map(tuple, df.collect()))
    of = {c[0]: c for c in calls}
    key = lambda t: program.tree_key(F.col(t)).alias("key")
    args = whole.members("V", facts["semantic_calls"].select("site", F.posexplode("arguments").alias("arg", "e")).select("site", "arg", key("e"))).select("site", "arg", "value").distinct()
    got = rows(run.argument_values)
    assert got == rows(args) and len(got) > 50
    got = rows(run.item_places)
    assert got == rows(facts["indirect_accesses"].select("item", key("location")).join(whole.rows("L"), "key").select("item", "value").distinct()) and len(got) > 20
    targets = whole.members("T").where("value is not null").collect()
    made = [(r.key[2:], r.value) for r in targets if of[int(r.key[2:])][3] is None]
    assert run.pointer_calls.count() == len(made) > 10


def test_direct_calls_are_no_instructions(spark):
    plain, fn = (lambda i: json.dumps({"op": "loc", "id": i}, separators=(",", ":"))), json.dumps({"op": "function", "id": "F1"})
    calls = spark.createDataFrame([(i, "F0", "call", None if i % 2 else "F1", fn if i % 2 else None, [plain("a"), None], plain(f"got{i}"), "a.c", 1, i) for i in range(40)], analysis.TABLES["semantic_calls"])
    of = lambda name: spark.createDataFrame([], analysis.TABLES[name])
    items = spark.createDataFrame([(1, "F0", f'{{"op":"deref","value":{plain("got4")}}}', "READ", "a.c", 1, 1)], analysis.TABLES["indirect_accesses"])
    made = program.run_instructions(of("constraints"), calls, items)
    counts = {r["op"]: r["count"] for r in made.distinct().groupBy("op").count().collect()}
    assert counts == {"LOC": 2, "READ": 2, "FUN": 1, "CALLEE": 1, "ARG": 2, "FLOW": 2}
    assert {(r.r, r.x) for r in made.where("op = 'FLOW'").collect()} == {("F1:param:0", "a"), ("got4", "F1:return")}


def test_large_fronts_take_one_step_and_go_past_the_driver(spark, monkeypatch):
    """The same paths, distances and masks whether a job takes one step or several; joins of the rounds are never broadcast."""
    rng = random.Random(7)
    names = [f"f{i}" for i in range(60)]
    edges = spark.createDataFrame([(rng.choice(names[:40]), rng.choice(names)) for _ in range(90)] + [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("f3", "c0")], "caller string, callee string")
    roots = spark.createDataFrame([(f"C{i % 3}", f) for i, f in enumerate(names[:6])], "context_id string, function_id string")
    masks = roots.selectExpr("function_id", "1L as mask")
    plans, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (plans.append(plan(df)), real(df))[1])
    rows = lambda df: sorted(map(str, df.collect()))
    every = lambda: [rows(graph.witness_paths(roots, edges)), rows(graph.closure(roots, edges, "context_id")), rows(graph.spread_masks(masks, edges))]
    several = every()
    monkeypatch.setattr(graph, "FRONT", 0)
    assert every() == several and len(several[0]) > 60
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_shuffle_files_of_a_round_go_with_it(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, was = files(), spark.conf.get(graph.END_SHUFFLES, None)
    made = graph.checkpointed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.5)
    assert not files() - before and made.count() == 7 and spark.conf.get(graph.END_SHUFFLES, None) == was
