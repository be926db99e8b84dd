"""Literal cases with known outcomes, on hand-written facts."""

import json
import sqlite3
import struct

import pytest

from factgraph.operators import contexts, graph, multicore, points_to, review, rules, scope, sets, text
from factgraph.sources import files

V = "symbol_id string, name string, qualified_name string, kind string, linkage string, size_bytes long, alignment_bytes long, is_const boolean, is_struct boolean, is_bitfield_container boolean, definition_file string, coverage_source string, parse_status string"
A = "access_id string, symbol_id string, function_id string, access_kind string, file string, line long, pos long, access_path string, via_alias boolean"
U = "kind string, symbol_id string, function_id string, target_function_id string, file string, line long"


def var(name, kind="GLOBAL", linkage="INTERNAL", **more):
    row = dict(symbol_id=name, name=name, qualified_name=name, kind=kind, linkage=linkage, size_bytes=4, alignment_bytes=4, is_const=False, is_struct=False, is_bitfield_container=False, definition_file="a.c", coverage_source="compile_database", parse_status="PARSED")
    return tuple((row | more).values())


def profile(spark, variables, accesses, roots=(), edges=(), functions=(), unknowns=(), snapshots=(), events=(), resources=(), protection=(), reentrant=()):
    """Rows of rules.profile by symbol. accesses: symbol, function, kind. roots: context, function."""
    frame = spark.createDataFrame
    functions = frame([(f, "EXTERNAL" if f in ("main", "isr", "task") else "INTERNAL") for f in dict.fromkeys([a[1] for a in accesses] + [f for _, f in roots] + [x for e in edges for x in e] + list(functions))], "function_id string, linkage string")
    roots_, edges_, unknowns = frame(list(roots), "context_id string, function_id string"), frame(list(edges), "caller string, callee string"), frame(list(unknowns), U)
    bindings = graph.witness_paths(roots_, edges_)
    seeds = bindings.select("function_id").union(unknowns.where("target_function_id is not null").select("target_function_id")).distinct()
    possible = graph.possible_functions(seeds, edges_, unknowns.where("kind = 'EXTERNAL_CALLEE'").select("function_id"), functions)
    reach = graph.reachability(functions, bindings, possible, unknowns)
    known = frame([(c, c in reentrant) for c in dict.fromkeys(c for c, _ in roots)], "context_id string, reentrant boolean")
    a = frame([(f"a{i}", s, f, k, "a.c", i + 1, i, "", False) for i, (s, f, k) in enumerate(accesses)], A)
    out = rules.profile(frame([v if isinstance(v, tuple) else var(v) for v in variables], V), rules.live_accesses(a, bindings, known, reach), unknowns, graph.taint(unknowns, edges_), reach, frame(list(snapshots), "symbol_id string, function_id string"),
                        frame(list(events), "function_id string, event_kind string"), frame(list(resources), "resource string, owner_context string, business_critical boolean"), frame(list(protection), "resource string"))
    return {r.symbol_id: r for r in out.collect()}


TWO = [("isr", "isr"), ("task", "task")]


def test_two_writers(spark):
    got = profile(spark, ["g"], [("g", "isr", "WRITE"), ("g", "task", "WRITE")], TWO)["g"]
    assert got.writers == ["isr", "task"] and {"GS-MULTI-WRITER", "GS-MULTI-CONTEXT"} <= set(got.rules) and (got.risk_level, got.confidence) == ("HIGH", "MEDIUM")


def test_snapshot_and_local_static(spark):
    got = profile(spark, ["g", var("s", "LOCAL_STATIC")], [("g", "main", "READ"), ("g", "isr", "RMW"), ("s", "isr", "WRITE"), ("s", "main", "READ")], [("isr", "isr"), ("MAIN", "main")], snapshots=[("g", "main")])
    assert "GS-STALE-SNAPSHOT" in got["g"].rules and "GS-LOCAL-STATIC-REENTRANT" in got["s"].rules and got["s"].n_live == 2


def test_screening_reasons(spark):
    variables = ["dead", "readonly", "unused", "one", "many", var("c", is_const=True)]
    accesses = [("dead", "gone", "WRITE"), ("readonly", "isr", "READ"), ("readonly", "task", "READ"), ("one", "task", "WRITE"), ("many", "task", "WRITE"), ("many", "task", "READ")]
    got = profile(spark, variables, accesses, TWO)
    assert {s: r.screening_reason for s, r in got.items()} == {"dead": "UNREACHABLE_ACCESSORS", "readonly": "ONLY_READS", "unused": "NO_RUNTIME_ACCESSES", "one": "SINGLE_ACCESS_SITE", "many": "SINGLE_EXECUTION_CONTEXT", "c": "NO_RUNTIME_ACCESSES"}
    assert all(not r.rules for r in got.values()) and got["dead"].n_all - got["dead"].n_live == 1


def test_opaque_library(spark):
    """A call out of the build holds up what it can name, not private objects."""
    got = profile(spark, ["private", var("exported", linkage="EXTERNAL")], [("private", "task", "WRITE"), ("exported", "task", "WRITE")], TWO, unknowns=[("EXTERNAL_CALLEE", None, "task", None, "a.c", 1)])
    assert got["private"].screening_reason == "SINGLE_ACCESS_SITE"
    assert got["exported"].rules == ["GS-COVERAGE-INCOMPLETE"] and got["exported"].blockers == ["EXTERNAL_CALLEE"]


def test_reentrant_single_write(spark):
    got = profile(spark, ["g"], [("g", "task", "WRITE")], TWO, reentrant=["task"])["g"]
    assert got.screening_reason is None and "GS-MULTI-WRITER" in got.rules


def test_protection_never_suppresses(spark):
    accesses = [("g", "isr", "WRITE"), ("g", "task", "WRITE"), ("h", "task", "WRITE")]
    got = profile(spark, ["g", "h"], accesses, TWO, events=[("isr", "lock_enter")], protection=[("g",), ("h",)])
    assert got["g"].protection_status == "PARTIAL" and "GS-MULTI-WRITER" in got["g"].rules and got["h"].protection_status == "DECLARED_ONLY"


def test_rules_of_single_variables(spark):
    variables = [var("sup", coverage_source="supplemental"), var("failed", parse_status="FAILED"), var("nodef", definition_file=None), "dma", "taken", "lost", "own", var("tear", size_bytes=8), var("st", is_struct=True)]
    accesses = [("failed", "task", "READ"), ("nodef", "task", "READ"), ("dma", "task", "READ"), ("taken", "task", "ADDRESS_TAKEN"), ("lost", "nowhere", "READ"), ("own", "task", "WRITE")] + [(s, f, "WRITE") for s in ("tear", "st") for f in ("isr", "task")]
    unknowns = [("DMA_SHARED_REVIEW", "dma", "task", None, "a.c", 1), ("FUNCTION_ADDRESS", None, "task", "nowhere", "a.c", 1)]
    got = profile(spark, variables, accesses, TWO, unknowns=unknowns, resources=[("own", "isr", True)])
    has = lambda s, *r: set(r) <= set(got[s].rules)
    assert got["sup"].rules == ["GS-SUPPLEMENTAL-UNANALYZED"] and got["sup"].blockers == ["ACCESS_NOT_ANALYZED"] and got["failed"].rules == ["GS-PARSE-INCOMPLETE"] and "PARSE_FAILED" in got["failed"].blockers
    assert has("nodef", "GS-DEFINITION-MISSING") and has("dma", "DMA_SHARED_REVIEW", "GS-INDIRECT-ACCESS") and has("taken", "GS-INDIRECT-ACCESS") and got["lost"].screening_reason == "ONLY_READS"
    assert has("own", "GS-OWNER-VIOLATION") and got["own"].risk_level == "CRITICAL" and has("tear", "GS-TEAR-RISK") and has("st", "GS-STRUCT-INCONSISTENT") and "GS-TEAR-RISK" not in got["st"].rules


def test_accountability_of_a_thousand(spark):
    got = profile(spark, [f"v{i}" for i in range(1000)] + ["race"], [("race", "isr", "WRITE"), ("race", "task", "WRITE")], TWO)
    assert len(got) == 1001 and sum(r.screening_reason is not None for r in got.values()) == 1000 and got["race"].rules
    rows = [(s, list(r.rules), r.screening_reason) for s, r in got.items()]
    good = spark.createDataFrame(rows, "symbol_id string, rules array<string>, screening_reason string")
    assert tuple(rules.accountability(good).first()) == (1001, 1000, 1)
    with pytest.raises(Exception, match="once"):
        rules.accountability(good.union(spark.createDataFrame([("x", [], None)], good.schema))).collect()


def test_witness_paths_and_cycles(spark):
    edges = spark.createDataFrame([("m", "b"), ("m", "a"), ("a", "t"), ("b", "t"), ("t", "m"), ("t", "u"), ("u", "w"), ("s", "s")], "caller string, callee string")
    paths = {r.function_id: r.path for r in graph.witness_paths(spark.createDataFrame([("c", "m")], "context_id string, function_id string"), edges).collect()}
    assert paths == {"m": ["m"], "a": ["m", "a"], "b": ["m", "b"], "t": ["m", "a", "t"], "u": ["m", "a", "t", "u"], "w": ["m", "a", "t", "u", "w"]}
    assert {tuple(r) for r in graph.cyclic_edges(edges).collect()} == {("m", "b"), ("m", "a"), ("a", "t"), ("b", "t"), ("t", "m"), ("s", "s")}
    assert graph.cyclic_edges(edges.where("false")).count() == 0


def test_scope_paths(spark):
    s = scope.Scope(["App/sub"], ["App/sub/vendor"], ["App/sub/x.c"], ["App/sub/gen?.c"])
    paths = ["App/sub/a.c", "App/sub/vendor_extra/a.c", "App/submarine/a.c", "App/sub/vendor/a.c", "App/sub/x.c", "App/sub/gen1.c", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(scope.contains(scope.F.col("p"), s)).collect()]
    assert got == [True, True, False, False, False, False, False, False]
    v = spark.createDataFrame([("own", "App/sub/a.c", "App/inc/a.h"), ("vendor", "App/sub/vendor/v.c", "App/sub/a.h"), ("decl", None, "App/sub/a.h"), ("none", None, None)], "symbol_id string, definition_file string, declaration_file string")
    assert {r.symbol_id for r in scope.select_variables(v, s).collect()} == {"own", "decl"}


F = "function_id string, name string, qualified_name string, file string, parameter_count int"


def test_context_names(spark):
    rows = [("1", "TIM4_IRQHandler", 0), ("2", "HAL_X_IRQHandler", 0), ("3", "main", 0), ("4", "A_IRQHandler", 1), ("5", "SysTick_Handler", 0), ("6", "f", 0)]
    f = spark.createDataFrame([(i, n, n, "a.c", p) for i, n, p in rows], F)
    got = {r.function_id: r.kind for r in contexts.auto_contexts(f, f.where("false").select("function_id")).collect()}
    assert got == {"1": "ISR", "3": "MAIN", "5": "ISR"}
    hit = contexts.match_specs(f, [("x", {"functions": ["a.c::f"], "regex": ["m.in"]}), ("y", {"patterns": ["*_IRQ*"]}), ("z", {"patterns": ["f["]})])
    assert {tuple(r) for r in hit.collect()} == {("x", "6"), ("x", "3"), ("y", "1"), ("y", "2"), ("y", "4")}


def test_registrations_share_contexts(spark):
    f = spark.createDataFrame([(n, n, n, "a.c", 0) for n in "abcde"], F)
    rows = [(1, "a", "r.c", 1, "TIMER", None, False, True), (2, "b", "r.c", 2, "DEFERRED", None, False, True), (3, "c", "r.c", 3, "ISR", "G", True, False), (4, "d", "r.c", 4, "ISR", "G", True, True),
            (5, "e", "r.c", 5, "TASK", "G", True, True), (6, "x", "r.c", 6, "TASK", None, False, True), (7, "e", "r.c", 7, "TASK", None, False, True), (8, "e", "r.c", 7, "TASK", None, False, True)]
    reg = spark.createDataFrame(rows, "ord long, function_id string, file string, pos long, kind string, given_id string, configured boolean, may_repeat boolean")
    none = f.where("false").select("function_id")
    made = contexts.registered(reg, f, none, none)
    got = {r.context_id: (r.kind, r.reentrant, r.n_registrations) for r in contexts.registration_contexts(made).collect()}
    own = [k for k in got if k.startswith("auto:task:e:")]
    assert len(own) == 1 and got == {"auto:freertos:timer_daemon": ("TASK", False, 2), "G": ("ISR", True, 2), own[0]: ("TASK", True, 1)}
    assert [r.ord for r in made.where("context_id is null").collect()] == [5]
    assert [r.target_function_id for r in contexts.undefined_entries(reg, f).collect()] == ["x"]
    used, unused = contexts.match_registrations(spark.createDataFrame([(1, "my_reg"), (2, "xTaskCreate"), (3, "no")], "site int, name string"), [{"api": "my_*"}, {"api": "*_reg"}, {"api": "q"}])
    assert {(r.site, r.spec, r.how) for r in used.collect()} == {(1, "spec0", "AMBIGUOUS"), (1, "spec1", "AMBIGUOUS"), (2, "xTaskCreate", "BUILT_IN")} and [r.api for r in unused.collect()] == ["q"]


def least_model(program, fields=16):
    """The rules of points_to.solve, applied until nothing changes."""
    known: set = set()
    while True:
        of = {}
        for rel, k, v in known:
            of.setdefault((rel, k), set()).add(v)
        get = lambda rel, k: of.get((rel, k), set())
        new = set()
        for op, r, x, name in program:
            if op in ("LOC", "FUN", "TARGET"):
                new.add({"LOC": ("L", r, name), "FUN": ("V", r, f"fn:{name}"), "TARGET": ("T", r, name)}[op])
            elif op in ("FIELD", "UNION_L", "ADDR"):
                new |= {("V" if op == "ADDR" else "L", r, f"{p}/{name}" if op == "FIELD" else p) for p in get("L", x)}
            elif op in ("DEREF", "UNION_V", "CALLEE"):
                new |= {("L" if op == "DEREF" else "V", r, p) for p in get("V", x) if op == "UNION_V" or op == "DEREF" and not p.startswith("fn:")} | ({("T", r, p[3:]) for p in get("V", x) if p.startswith("fn:")} if op == "CALLEE" else set())
            elif op == "READ":
                new |= {("V", r, q) for p in get("L", x) for q in get("P", p)}
            elif op == "ASSIGN":
                new |= {("P", p, q) for p in get("L", r) for q in get("V", x)}
            elif op == "ARG":
                new |= {("P", f"{t}:param:{name}", q) for t in get("T", r) for q in get("V", x)}
            else:
                new |= {("P", p, q) for t in get("T", r) for p in get("L", x) for q in get("P", f"{t}:return")}
        new = {n for n in new if n[2].count("/") < fields}
        if new <= known:
            return known
        known |= new


PROGRAM = [
    ("LOC", "cb", None, "obj:table"), ("FIELD", "f1", "cb", "first"), ("FIELD", "f2", "cb", "second"), ("FUN", "h", None, "handler"), ("ASSIGN", "f1", "h", None),  # table.first = handler
    ("LOC", "pay", None, "obj:payload"), ("ADDR", "apay", "pay", None), ("READ", "rf", "f1", None), ("CALLEE", "c1", "rf", None), ("ARG", "c1", "apay", "0"),  # table.first(&payload)
    ("LOC", "par", None, "handler:param:0"), ("READ", "vpar", "par", None), ("DEREF", "dpar", "vpar", None),  # *param
    ("LOC", "ret", None, "handler:return"), ("ASSIGN", "ret", "vpar", None), ("LOC", "res", None, "local:r"), ("RESULT", "c1", "res", None),  # r = the call
    ("UNION_V", "u", "apay", None), ("UNION_V", "u", "h", None), ("LOC", "m", None, "local:m"), ("ASSIGN", "m", "u", None), ("TARGET", "c2", None, "direct"), ("ARG", "c2", "u", "1"),
    ("LOC", "no", None, "local:no"), ("READ", "vno", "no", None), ("DEREF", "dno", "vno", None),
]


def test_points_to(spark):
    known, hit = points_to.solve(spark.createDataFrame(PROGRAM, "op string, r string, x string, name string"))
    assert {tuple(r) for r in known.collect()} == least_model(PROGRAM) and not hit
    targets = {r.location: r.targets for r in points_to.pointer_targets(known).collect()}
    assert targets["obj:table/first"] == "fn:handler" and "obj:table/second" not in targets and targets["local:r"] == targets["handler:param:0"] == "obj:payload"
    calls = spark.createDataFrame([("c1", "main"), ("c2", "main")], "site string, function_id string")
    assert {(r.site, r.callee) for r in points_to.indirect_calls(known, calls).collect()} == {("c1", "handler"), ("c2", "direct")}
    items = spark.createDataFrame([("i1", "dpar", "WRITE"), ("i2", "dno", "READ"), ("i3", "f2", "READ")], "item string, r string, mode string")
    objects = spark.createDataFrame([("payload",), ("table",)], "symbol_id string")
    assert {tuple(r) for r in points_to.indirect_accesses(known, items, objects).collect()} == {("i1", "payload", "", "WRITE"), ("i2", None, None, "UNRESOLVED_POINTEE"), ("i3", "table", "/second", "READ")}


def test_points_to_shares_sets(spark):
    """F1 to F4: many calls through one place that holds many functions; only what is asked for is paired."""
    n = 60
    rows = [("LOC", "slot", None, "obj:slot"), ("LOC", "o", None, "obj:o"), ("ADDR", "a", "o", None)]
    for i in range(n):
        rows += [("FUN", f"f{i}", None, f"F{i}"), ("ASSIGN", "slot", f"f{i}", None), ("READ", f"w{i}", "slot", None), ("CALLEE", f"c{i}", f"w{i}", None), ("ARG", f"c{i}", "a", "0"), ("LOC", f"r{i}", None, f"local:{i}"), ("RESULT", f"c{i}", f"r{i}", None), ("LOC", f"b{i}", None, f"F{i}:return"), ("ASSIGN", f"b{i}", "a", None)]
    program = spark.createDataFrame(rows, "op string, r string, x string, name string")
    found = points_to.solution(program)
    assert {tuple(r) for r in found.known.collect()} == least_model(rows) and found.table.count() < 20 * n
    calls = spark.createDataFrame([(f"c{i}", "main") for i in range(n)] + [("none", "main")], "site string, function_id string")
    want = sorted((f"c{i}", f"F{j}") for i in range(n) for j in range(n))
    assert sorted((r.site, r.callee) for r in points_to.calls_through(found, calls).collect()) == want == sorted((r.site, r.callee) for r in points_to.indirect_calls(found.known, calls).collect())


def test_points_to_limit(spark):
    """p = &p->f grows without end: the fields that fit stay, and the limit is told."""
    rows = [("LOC", "p", None, "local:p"), ("LOC", "o", None, "obj:o"), ("ADDR", "a", "o", None), ("ASSIGN", "p", "a", None), ("READ", "v", "p", None), ("DEREF", "d", "v", None), ("FIELD", "f", "d", "f"), ("ADDR", "af", "f", None), ("ASSIGN", "p", "af", None)]
    known, hit = points_to.solve(spark.createDataFrame(rows, "op string, r string, x string, name string"), fields=4)
    assert hit and {tuple(r) for r in known.collect()} == least_model(rows, 4)


def test_text(spark):
    source = '#ifndef G\n#define G\n#if A /* x\n y */ \\\n && B\nint a; // #else\n#else\nchar *s = "/* no */";\n#endif\n#endif\n'
    f = spark.createDataFrame([("f", source), ("open", "#if A\n#if B\n#endif"), ("shut", "#endif\n#if A"), ("none", ""), ("null", None)], "file string, text string")
    blank = f.select("file", text.strip_comments(text.F.col("text")).alias("t")).collect()
    assert len(blank[0].t) == len(source) and "no */" in blank[0].t and "#else\n#else" not in blank[0].t.replace(" ", "") and blank[0].t.count("\n") == source.count("\n") and blank[4].t is None
    d = text.directives(f)
    assert [(r.start, r.end, r.cmd) for r in d.where("file = 'f'").orderBy("start").collect()] == [(1, 1, "ifndef"), (2, 2, "define"), (3, 3, "if"), (7, 7, "else"), (9, 9, "endif"), (10, 10, "endif")]
    arms = {(r.file, r.open, r.nth): (r.start, r.stop, r.parent, r.guard) for r in text.conditional_branches(d).collect()}
    assert arms == {("f", 1, 1): (1, 9, None, True), ("f", 3, 1): (3, 6, 1, False), ("f", 3, 2): (7, 8, 1, False), ("open", None, None): (None, None, None, None), ("shut", None, None): (None, None, None, None)}


def test_branch_variants(spark):
    source = "#if A\n#if B \\\n && C\nx\n#elif D\ny\n#endif\n#else\nz\n#endif"
    guarded = "#ifndef G\n#define G\n#ifdef Q\nq\n#endif\n#endif"
    f = spark.createDataFrame([("f", source), ("g", guarded), ("open", "#if A"), ("none", ""), ("null", None)], "file string, text string")
    d = text.directives(f)
    got = {(r.file, r.open, r.nth): r.text for r in text.branch_variants(f, d, text.conditional_branches(d)).collect()}
    tail = "\nx\n#elif D\ny\n#endif\n#else\nz\n#endif"
    assert got == {
        ("f", 1, 1): "#if 1\n#if B \\\n && C" + tail, ("f", 1, 2): "#if 0\n#if B \\\n && C" + tail,
        ("f", 2, 1): "#if 1\n#if 1  \n     " + tail.replace("#elif D", "#elif 0"), ("f", 2, 2): "#if 1\n#if 0  \n     " + tail.replace("#elif D", "#elif 1"),
        ("g", 3, 1): guarded.replace("#ifdef Q", "#if 1   "),
    }


def test_rule_order(spark):
    rows = [(["GS-MULTI-CONTEXT", "X", "GS-RMW-INTERLEAVE", "A", "GS-MULTI-CONTEXT", "X", None],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "rules array<string>").select(review.ordered_rules(review.F.col("rules"))).collect()]
    assert got == [["GS-RMW-INTERLEAVE", "GS-MULTI-CONTEXT", "X", "A", "X", None], [], None]


def test_decisions(spark):
    findings = [("f1", "likely", ["GS-MULTI-WRITER"]), ("f2", "open", ["GS-UNKNOWN-CONTEXT"]), ("f3", "bad", ["GS-UNKNOWN-CONTEXT"]), ("f4", "safe", ["GS-MULTI-WRITER"]), ("f5", "stale", ["GS-MULTI-WRITER"]), ("f6", "failed", ["GS-DEFINITION-MISSING"]), ("f7", "bad", ["GS-TEAR-RISK"])]
    reviews = [("f3", "DONE", "CONFIRMED"), ("f4", "DONE", "FALSE_POSITIVE"), ("f5", "STALE", "NEED_MORE_CONTEXT"), ("f6", "FAILED", "CONFIRMED"), ("f7", "DONE", "REVIEWED_SAFE")]
    records = review.review_records(spark.createDataFrame(findings, "finding_id string, symbol_id string, rules array<string>"), spark.createDataFrame(reviews, "finding_id string, state string, status string"))
    names = ["likely", "open", "bad", "safe", "stale", "failed", "calm", "none"]
    v = spark.createDataFrame([(n, "compile_database", "PARSED", "SCREENED_NO_CONCURRENCY_RISK" if n == "calm" else "X") for n in names] + [("sup", "supplemental", "PARSED", "X"), ("broken", "compile_database", "FAILED", "X")], "symbol_id string, coverage_source string, parse_status string, audit_status string")
    d = review.variable_decisions(v, records)
    assert {r.symbol_id: r.decision for r in d.collect()} == {"likely": "likely", "open": "unresolved", "bad": "confirmed", "safe": "safe", "stale": "likely", "failed": "unresolved", "calm": "screened_safe", "none": "inventory", "sup": "supplemental", "broken": "unresolved"}
    assert review.final_conclusion(records, True).first().verdict == "HAS_ISSUES" and review.final_conclusion(records.where("symbol_id = 'safe'"), True).first().verdict == "NO_ISSUES_IN_SCOPE"
    assert {r.decision: r.n_variables for r in review.risk_summary(d).collect()}["confirmed"] == 1


def answer(**changes):
    ref = dict(evidence_refs=[1])
    actor = lambda i: dict(id=i, label="l", eligibility="ACTUAL", entry="e", access="a", **ref)
    step = lambda i: dict(actor_id=i, action="x", state_before="0", state_after="1", **ref)
    base = dict(finding_id="f", status="CONFIRMED", reason="r", interleaving="i", protection="p", impact="m", fix="x", verification="v", schema_version=2, review_type="VARIABLE", evidence=[dict(file="a.c", line=1, quote="q", claim="c")],
                explanation=dict(summary="s", cause="c", scheduling="s", missing_evidence=[], participants=[actor("A"), actor("B")], scenarios=[dict(title="t", kind="CONFLICT", precondition="p", expected="e", actual="a", steps=[step("A"), step("B")])], **ref))
    for path, value in changes.items():
        *way, last = path.split("__")
        at = base
        for key in way:
            at = at[int(key)] if key.isdigit() else at[key]
        at[int(last) if last.isdigit() else last] = value
    return json.dumps(base)


def test_answer_contract(spark):
    e = "explanation__"
    cases = [({}, None), ({"finding_id": "other"}, "FINDING_ID"), ({"status": "MAYBE"}, "STATUS"), ({"fix": " "}, "NO_FIX"), ({"evidence": []}, "EVIDENCE"), ({"schema_version": 1}, "SCHEMA_VERSION"), ({"review_type": "EVIDENCE_GAP"}, "REVIEW_TYPE"), ({e + "summary": "x" * 181}, "SUMMARY_LENGTH"),
             ({e + "evidence_refs": [2]}, "EXPLANATION_REFS"), ({e + "participants__1__id": "A"}, "PARTICIPANT_TWICE"), ({e + "participants__0__eligibility": "X"}, "ELIGIBILITY"), ({e + "participants__1__eligibility": "UNKNOWN"}, "STEP_NOT_ACTUAL"), ({e + "scenarios__0__steps__1__actor_id": "A"}, "CONFLICT_STEPS"),
             ({e + "scenarios__0__steps__0__actor_id": "Z"}, "STEP_ACTOR"), ({"status": "REVIEWED_SAFE"}, "SCENARIO_KIND"), ({e + "scenarios": []}, "NO_CONFLICT"), ({"status": "LIKELY", e + "scenarios__0__kind": "UNRESOLVED"}, "MISSING_EVIDENCE"), ({e + "scenarios__0__steps__0__evidence_refs": [0]}, "STEP_REFS"), ({e + "missing_evidence": None}, "MISSING_EVIDENCE")]
    frame = spark.createDataFrame([("f", answer(**c), "VARIABLE", i) for i, (c, _) in enumerate(cases)] + [("f", "no json", "VARIABLE", 99)], "finding_id string, answer string, review_type string, i int").orderBy("i").coalesce(1)
    assert [r.problem for r in review.answer_violations(frame).collect()] == [p for _, p in cases] + ["NOT_JSON"]


def test_queue_and_budget(spark):
    f = spark.createDataFrame([(f"f{i:03}", "HIGH") for i in range(250)], "finding_id string, risk_level string")
    first = review.queue_limit(f, review.F.lit(False), 73)
    assert first.count() == 73 and review.queue_limit(f, review.F.col("finding_id") < "f073", 0).count() == 177
    sizes = spark.createDataFrame([("g", "a", 1000), ("g", "b", 900), ("g", "c", 500), ("h", "a", 2000)], "group_id string, function_id string, n_lines int")
    assert {tuple(r) for r in review.line_budget(sizes).collect()} == {("g", "a"), ("g", "c")}


def test_snapshot_witness(spark):
    acc = [("r", "g", "m", "READ", "a.c", 5, 0, "", False), ("w", "g", "m", "WRITE", "a.c", 9, 0, "", False), ("i", "g", "irq", "WRITE", "a.c", 20, 0, "", False)]
    run = lambda rows, snaps=(("g", "m"),): [tuple(r) for r in review.snapshot_witness(spark.createDataFrame(rows, A), spark.createDataFrame(list(snaps), "symbol_id string, function_id string"), spark.createDataFrame([("main", "m", 0), ("irq", "irq", 0)], "context_id string, function_id string, call_depth int"), spark.createDataFrame([("main", "MAIN"), ("irq", "ISR")], "context_id string, kind string")).collect()]
    change = lambda i, **c: [tuple((dict(zip([x.split()[0] for x in A.split(", ")], row)) | (c if j == i else {})).values()) for j, row in enumerate(acc)]
    assert run(acc) == [("g", "main", "r", "irq", "i", "w")]
    assert run(change(1, line=4)) == run(change(2, access_path="/x")) == run(change(1, file="b.c")) == run(acc, (("g", "irq"),)) == []


def elf():
    names, body = b"\0a.c\0shared\0func\0", b""
    for name, address, size, info, section in ((1, 0, 0, 4, 0), (5, 0x2000, 8, 0x11, 1), (12, 0x10, 4, 0x12, 1), (5, 0x30, 0, 0x11, 1)):
        body += struct.pack("<IIIBBH", name, address, size, info, 0, section)
    header = b"\x7fELF\x01\x01\x01" + bytes(9) + struct.pack("<HHIIIIIHHHHHH", 2, 40, 1, 0, 0, 52 + len(names) + len(body), 0, 52, 0, 0, 40, 3, 0)
    sections = bytes(40) + struct.pack("<10I", 0, 2, 0, 0, 52 + len(names), len(body), 2, 0, 0, 16) + struct.pack("<10I", 0, 3, 0, 0, 52, len(names), 0, 0, 0, 0)
    return header + names + body + sections


def test_elf_and_cores(spark):
    images = spark.createDataFrame([("m4", bytearray(elf())), ("m7", bytearray(elf()))], "path string, content binary")
    objects = multicore.elf_objects(multicore.elf_symbols(images))
    assert {tuple(r) for r in objects.collect()} == {(p, "shared", 0x2000, 8, 1, "a.c") for p in ("m4", "m7")}
    v = spark.createDataFrame([(p, s, s, "d/a.c") for p in ("m4", "m7") for s in ("shared", "own")], "variant string, symbol_id string, name string, definition_file string")
    ids = multicore.linked_objects(v, objects.withColumnRenamed("path", "variant"), [(0x2000, 8)])
    assert {(r.symbol_id, r.combined_id) for r in ids.where("variant = 'm4'").collect()} == {("shared", "shared:0x2000:8"), ("own", "m4::own")}
    cores = lambda *names: spark.createDataFrame(list(zip(("m4", "m7"), names)), "variant string, core string")
    assert [(r.combined_id, r.n_cores) for r in multicore.cross_core(ids, cores("m4", "m7")).collect()] == [("shared:0x2000:8", 2)]
    assert multicore.cross_core(ids, cores("m4", "m4")).count() == 0  # two variants of one core
    with pytest.raises(Exception, match="ELF32"):
        multicore.elf_symbols(spark.createDataFrame([("x", bytearray(b"no elf"))], images.schema)).collect()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps([{"file": "a.c", "directory": "/w"}, {"file": "b.c", "directory": "/w"}]))
    entries = sets.compile_entries(files.read_compile_database(spark, f"{tmp_path}/db.json"))
    assert [(r.tu, r.file) for r in entries.orderBy("tu").collect()] == [(0, "a.c"), (1, "b.c")]
    with pytest.raises(Exception, match="without a file"):
        sets.compile_entries(spark.createDataFrame([(1, "{}")], "tu int, entry string")).collect()
    df = spark.createDataFrame([("g", "f", [1, 2], None)], "symbol_id string, function_id string, contexts array<int>, note string")
    files.write_json(df, f"{tmp_path}/facts")
    assert files.read_facts(spark, f"{tmp_path}/facts", "symbol_id string, function_id string, contexts array<int>, note string").collect() == df.collect()
    files.write_sqlite({"accesses": df, "none": df.where("false")}, f"{tmp_path}/facts.db")
    con = sqlite3.connect(f"{tmp_path}/facts.db")
    assert con.execute("SELECT contexts, function_id, note, symbol_id FROM accesses").fetchall() == [("[1,2]", "f", None, "g")] and con.execute("SELECT count(*) FROM none").fetchall() == [(0,)]
    assert {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'index'")} == {"access_symbol_id", "access_function_id"}
