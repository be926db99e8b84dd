"""Review records, decisions, the answer contract and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.intervals import points_in_ranges
#: Rules that point to concurrency, decisions in order, grades in order, statuses of an answer.
SIGNALS = ["GS-MULTI-CONTEXT", "GS-MULTI-WRITER", "GS-RMW-INTERLEAVE", "GS-STALE-SNAPSHOT", "DMA_SHARED_REVIEW", "GS-LOCAL-STATIC-REENTRANT", "GS-OWNER-VIOLATION"]
PRIORITY = ["confirmed", "likely", "unresolved", "safe"]
DECISIONS = [*PRIORITY, "screened_safe", "inventory", "supplemental"]
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
STATUSES = ["CONFIRMED", "LIKELY", "REVIEWED_SAFE", "FALSE_POSITIVE", "NEED_MORE_CONTEXT"]
TERMINAL = ["CONFIRMED", "REVIEWED_SAFE", "FALSE_POSITIVE"]
SAFE = ["REVIEWED_SAFE", "FALSE_POSITIVE"]
LINE_BUDGET = 1600
#: Rules and gap kinds in the order in which a report explains them.
RULE_ORDER = ["GS-RMW-INTERLEAVE", "GS-STALE-SNAPSHOT", "DMA_SHARED_REVIEW", "GS-MULTI-WRITER", "GS-TEAR-RISK", "GS-STRUCT-INCONSISTENT", "GS-LOCAL-STATIC-REENTRANT", "GS-OWNER-VIOLATION", "GS-UNKNOWN-CONTEXT", "GS-INDIRECT-ACCESS", "GS-DEFINITION-MISSING", "GS-NO-ACCESS-EVIDENCE",
              "GS-COVERAGE-INCOMPLETE", "GS-FILE-STATIC-SHARED", "GS-MULTI-CONTEXT", "EXTERNAL_CALLEE", "FUNCTION_ADDRESS", "INDIRECT_CALL", "INLINE_ASSEMBLY", "POINTER_DEREFERENCE", "POINTER_SUBSCRIPT", "UNRESOLVED_POINTEE", "PARSE_FAILED", "EMPTY_AUDIT_SCOPE"]


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def rank(values: list[str], of: Column) -> Column:
    """Place of a value in the list, after all for others."""
    return F.coalesce(F.nullif(F.array_position(strings(values), of), F.lit(0)), F.lit(len(values) + 1))


def ordered_rules(rules: Column, order: list[str] = RULE_ORDER) -> Column:
    """The rules of the list `order` in its order, each once, then all others as they come, repeats included. Null stays null."""
    known = F.array_intersect(strings(order), rules)
    return F.when(rules.isNotNull(), F.concat(known, F.filter(rules, lambda r: ~F.coalesce(F.array_contains(strings(order), r), F.lit(False)))))


def latest(events: DataFrame) -> DataFrame:
    """finding_id with the state and status of its last event, the number of earlier ones and the pass; a second pass replaces the first."""
    return events.groupBy("finding_id").agg(F.max_by(F.struct("state", "status", "pass"), F.struct("pass", "seq")).alias("x"), (F.count("*") - 1).alias("n_previous")).select("finding_id", "x.state", "x.status", "x.pass", "n_previous")


def review_records(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every finding with its review; without one it is pending, which never means safe."""
    r = reviews.select("finding_id", "state", "status")
    return findings.join(r, "finding_id", "left").withColumns({"state": F.coalesce("state", F.lit("PENDING")), "status": F.coalesce("status", F.lit("NEED_MORE_CONTEXT"))})


def category() -> Column:
    done = F.col("state") == "DONE"
    return F.when(done & (F.col("status") == "CONFIRMED"), "confirmed").when(done & (F.col("status") == "LIKELY"), "likely").when(done & F.col("status").isin(SAFE), "safe").otherwise("unresolved")


def decision() -> Column:
    """The review's category; an unresolved finding with a sign of concurrency is likely."""
    return F.when(category() != "unresolved", category()).when(F.arrays_overlap("rules", strings(SIGNALS)), "likely").otherwise("unresolved")


def variable_decisions(variables: DataFrame, records: DataFrame) -> DataFrame:
    """symbol_id, decision: the gravest of its findings; supplemental ones count only if every finding is confirmed or safe."""
    d = records.where("symbol_id is not null").withColumn("decision", decision())
    per = d.groupBy("symbol_id").agg(F.min_by("decision", rank(PRIORITY, F.col("decision"))).alias("gravest"), F.bool_and(F.col("decision").isin("confirmed", "safe")).alias("settled"))
    supplemental = F.col("coverage_source").isin("supplemental", "inactive_branch")
    out = F.when(supplemental, F.when(F.col("settled"), F.col("gravest")).otherwise("supplemental")).when(F.col("parse_status") == "FAILED", "unresolved").when(F.col("gravest").isNotNull(), F.col("gravest"))
    out = out.when(F.col("audit_status") == "SCREENED_NO_CONCURRENCY_RISK", "screened_safe").otherwise("inventory")
    return variables.join(per, "symbol_id", "left").select("symbol_id", out.alias("decision"))


def risk_summary(decisions: DataFrame) -> DataFrame:
    """decision, n_variables of all seven decisions, also where it is 0."""
    every = decisions.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    return every.join(decisions.groupBy("decision").agg(F.count("*").alias("n")), "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n_variables"))


def independent_gaps(findings: DataFrame) -> DataFrame:
    """independent_gaps: findings that belong to no variable."""
    return findings.agg(F.count_if(F.col("symbol_id").isNull()).alias("independent_gaps"))


def final_conclusion(records: DataFrame, complete: bool) -> DataFrame:
    """verdict, confirmed, unresolved, total, reviewed. Confirmed gaps stay open questions while no variable is confirmed."""
    c, of_variable = category(), F.col("symbol_id").isNotNull()
    n = records.agg(F.count_if(of_variable & (c == "confirmed")).alias("confirmed"), F.count_if(c.isin("unresolved", "likely")).alias("open"), F.count_if(~of_variable & (c == "confirmed")).alias("gaps"), F.count("*").alias("total"), F.count_if(F.col("state") == "DONE").alias("reviewed"))
    unresolved = F.col("open") + F.when(F.col("confirmed") == 0, F.col("gaps")).otherwise(0)
    verdict = F.when(F.col("confirmed") > 0, "HAS_ISSUES").when((unresolved > 0) | F.lit(not complete), "INCONCLUSIVE").otherwise("NO_ISSUES_IN_SCOPE")
    return n.select(verdict.alias("verdict"), "confirmed", unresolved.alias("unresolved"), "total", "reviewed")


def review_summary(records: DataFrame) -> DataFrame:
    """total, confirmed, likely, unresolved, safe findings; queued variables and those of which every finding is settled."""
    r = records.withColumn("c", category())
    counts = r.agg(F.count("*").alias("total"), *[F.count_if(F.col("c") == k).alias(k) for k in PRIORITY])
    per = r.where("symbol_id is not null").groupBy("symbol_id").agg(F.bool_and(F.col("c").isin("confirmed", "safe")).alias("settled")).agg(F.count("*").alias("queued"), F.count_if("settled").alias("terminal"))
    return counts.withColumns({"queued": per.select("queued").scalar(), "terminal": per.select("terminal").scalar()})


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(rank(LEVELS, F.col("risk_level")), "finding_id")


def display_order(records: DataFrame) -> DataFrame:
    """Findings by decision, grade, number of signals, name and id, with their decision and signals."""
    d = records.withColumn("decision", decision()).withColumn("n_signals", F.size(F.array_intersect("rules", strings(SIGNALS))))
    return d.orderBy(rank(PRIORITY, F.col("decision")), rank(LEVELS, F.col("risk_level")), F.desc("n_signals"), "variable_name", "finding_id").select("finding_id", "decision", "risk_level", "n_signals")


def access_previews(accesses: DataFrame, keep: int = 2) -> DataFrame:
    """symbol_id, place, access_id: the first accesses of two functions, those of MAIN first, then RMW, WRITE, READ, then short chains; no address-taking.

    accesses: symbol_id, function_id, access_id, access_kind, main, chain (functions on the shortest path, null if none).
    """
    order = [F.col("main").cast("int").desc(), rank(["RMW", "WRITE", "READ"], F.col("access_kind")), F.coalesce("chain", F.lit(999)), F.col("access_id")]
    a = accesses.where("access_kind <> 'ADDRESS_TAKEN'")
    a = a.withColumn("nth", F.row_number().over(Window.partitionBy("symbol_id", "function_id").orderBy(*order))).where("nth = 1")
    return a.withColumn("place", F.row_number().over(Window.partitionBy("symbol_id").orderBy(*order))).where(F.col("place") <= keep).select("symbol_id", "place", "access_id")


def queue_limit(records: DataFrame, cached: Column, limit: int) -> DataFrame:
    """finding_id of the next findings to review: at most `limit` (0: all) of those that no cache answers, by grade and id."""
    todo = records.where(~cached).orderBy(rank(LEVELS, F.col("risk_level")), "finding_id").select("finding_id")
    return todo.limit(limit) if limit else todo


def line_budget(functions: DataFrame, budget: int = LINE_BUDGET) -> DataFrame:
    """group_id, function_id of the functions supplied: each in order of its id if it still fits, so a later small one may.

    functions: group_id, function_id, n_lines.
    """
    ordered = functions.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("function_id", F.col("n_lines").cast("long").alias("n")))).alias("f"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("kept"))
    step = lambda a, f: F.struct((a["left"] - F.when(f["n"] <= a["left"], f["n"]).otherwise(0)).alias("left"), F.when(f["n"] <= a["left"], F.array_append(a["kept"], f["function_id"])).otherwise(a["kept"]).alias("kept"))
    return ordered.select("group_id", F.explode(F.aggregate("f", start, step, lambda a: a["kept"])).alias("function_id"))


def source_windows(accesses: DataFrame, before: int = 5, after: int = 3) -> DataFrame:
    """group_id, file, line around accesses, once each."""
    return accesses.select("group_id", "file", F.explode(F.sequence(F.greatest(F.col("line") - before, F.lit(1)), F.col("line") + after)).alias("line")).distinct()


def source_manifest(functions: DataFrame, supplied: DataFrame) -> DataFrame:
    """group_id, function_id, complete: whether every line of the function is among the supplied (group_id, file, line)."""
    n = points_in_ranges(supplied.distinct(), functions, ["group_id", "file"], "line", "start_line", "end_line").groupBy("group_id", "function_id").agg(F.count("*").alias("n"))
    return functions.join(n, ["group_id", "function_id"], "left").select("group_id", "function_id", (F.coalesce("n", F.lit(0)) == F.col("end_line") - F.col("start_line") + 1).alias("complete"))


def requirements(accesses: DataFrame, rules: DataFrame, blockers: DataFrame, functions: DataFrame) -> DataFrame:
    """finding_id, id of everything that a review must answer, once each."""
    parts = [(accesses, "access:", "access_id"), (rules, "rule:", "rule"), (blockers, "blocker:", "blocker"), (functions, "function:", "function_id")]
    one, *rest = [df.select("finding_id", F.concat(F.lit(prefix), c).alias("id")) for df, prefix, c in parts]
    for r in rest:
        one = one.union(r)
    return one.distinct()


def investigation_check(rows: DataFrame, required: DataFrame, answers: DataFrame) -> DataFrame:
    """finding_id, id, problem of investigations (finding_id, id, assessment, refs) against what is required; answers: finding_id, status, n_evidence.

    Null references are BAD_REF, as are those beyond the answer's evidence; rows of a finding without an answer are NO_ANSWER.
    """
    key = ["finding_id", "id"]
    missing = required.join(rows, key, "left_anti").select(*key, F.lit("MISSING").alias("problem"))
    extra = rows.join(required, key, "left_anti").select(*key, F.lit("NOT_REQUIRED").alias("problem"))
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("REPEATED").alias("problem"))
    r = rows.join(answers.withColumn("answered", F.lit(True)), "finding_id", "left")
    bad = F.when(F.col("answered").isNull(), "NO_ANSWER").when(F.trim(F.coalesce("assessment", F.lit(""))) == "", "NO_ASSESSMENT").when(F.col("refs").isNull() | F.exists("refs", lambda i: i.isNull() | (i < 1) | (i > F.col("n_evidence"))), "BAD_REF").when(F.col("status").isin(TERMINAL) & (F.size("refs") == 0), "NO_EVIDENCE")
    wrong = r.select(*key, bad.alias("problem")).where("problem is not null")
    return missing.union(extra).union(twice).union(wrong)


def receipt_check(receipts: DataFrame, logs: DataFrame) -> DataFrame:
    """finding_id, verdict: OK, NO_LOG, LOG_CHANGED or STATUS_CHANGED against the saved log (finding_id, log, status)."""
    r = receipts.join(logs.select("finding_id", "log", F.col("status").alias("log_status")), "finding_id", "left")
    return r.select("finding_id", F.when(F.col("log").isNull(), "NO_LOG").when(F.sha2("log", 256) != F.col("log_sha256"), "LOG_CHANGED").when(~F.col("status").eqNullSafe(F.col("log_status")), "STATUS_CHANGED").otherwise("OK").alias("verdict"))


def cache_reuse(current: DataFrame, cached: DataFrame) -> DataFrame:
    """finding_id, reuse: whether a finished, final answer of the same key is kept; open questions are asked again."""
    c = cached.select("finding_id", F.col("cache_key").alias("old_key"), "state", "status")
    ok = (F.col("old_key") == F.col("cache_key")) & (F.col("state") == "DONE") & F.col("status").isin(TERMINAL)
    return current.join(c, "finding_id", "left").select("finding_id", F.coalesce(ok, F.lit(False)).alias("reuse"))


def staled(reviews: DataFrame, fingerprint: Column) -> DataFrame:
    """Finished reviews of another scan are STALE and need more context."""
    old = (F.col("state") == "DONE") & ~F.col("scan_fingerprint").eqNullSafe(fingerprint)
    return reviews.withColumns({"state": F.when(old, "STALE").otherwise(F.col("state")), "status": F.when(old, "NEED_MORE_CONTEXT").otherwise(F.col("status"))})


def exit_code(run: DataFrame) -> DataFrame:
    """run_id, code: 130 interrupted, 3 failed, 2 incomplete, 1 with findings, else 0."""
    return run.select("run_id", F.when(F.col("interrupted"), 130).when(F.col("failed"), 3).when(~F.col("complete") | (F.col("pending") > 0), 2).when(F.col("findings") > 0, 1).otherwise(0).alias("code"))


REFS = "array<int>"
ANSWER = f"""finding_id string, status string, reason string, interleaving string, protection string, impact string, fix string, verification string, schema_version int, review_type string,
evidence array<struct<file string, line int, quote string, claim string>>,
explanation struct<summary string, cause string, scheduling string, evidence_refs {REFS}, missing_evidence array<string>,
  participants array<struct<id string, label string, eligibility string, entry string, access string, evidence_refs {REFS}>>,
  scenarios array<struct<title string, kind string, precondition string, expected string, actual string,
    steps array<struct<actor_id string, action string, state_before string, state_after string, evidence_refs {REFS}>>>>>"""


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def too_long(c: Column, n: int) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def answer_violations(answers: DataFrame) -> DataFrame:
    """finding_id, problem: the first rule of the answer's form that an answer (finding_id, answer as JSON, review_type expected) breaks; null if it keeps all.

    Covers the base fields and version 2 of the explanation; evidence is held against sources by evidence_check.
    """
    a, e = F.col("a"), F.col("a.explanation")
    status, n_evidence = a["status"], F.coalesce(F.size(a["evidence"]), F.lit(0))
    actors, scenarios = F.coalesce(e["participants"], F.array().cast("array<struct<id string, label string, eligibility string, entry string, access string, evidence_refs array<int>>>")), e["scenarios"]
    ids = F.transform(actors, lambda p: p["id"])
    actual = F.transform(F.filter(actors, lambda p: p["eligibility"] == "ACTUAL"), lambda p: p["id"])
    bad_refs = lambda r, empty_ok=False: r.isNull() | F.exists(r, lambda i: i.isNull() | (i < 1) | (i > n_evidence)) | (F.lit(not empty_ok) & (F.size(r) == 0))
    some = lambda items, test: F.coalesce(F.exists(items, test), F.lit(False))
    steps = lambda test: some(scenarios, lambda s: some(s["steps"], lambda t: test(s, t)))
    text = ("reason", "interleaving", "protection", "impact", "fix", "verification")
    missing = e["missing_evidence"]
    rules = [
        ("NOT_JSON", F.try_parse_json("answer").isNull()), ("FINDING_ID", ~a["finding_id"].eqNullSafe(F.col("finding_id"))), ("STATUS", ~F.coalesce(status.isin(STATUSES), F.lit(False))),
        *[(f"NO_{t.upper()}", blank(a[t])) for t in text], ("EVIDENCE", a["evidence"].isNull() | ((status != "NEED_MORE_CONTEXT") & (n_evidence == 0))),
        ("EVIDENCE_ITEM", some(a["evidence"], lambda x: blank(x["file"]) | F.coalesce(x["line"] < 1, F.lit(True)) | blank(x["quote"]))), ("CLAIM", some(a["evidence"], lambda x: blank(x["claim"]))),
        ("SCHEMA_VERSION", ~a["schema_version"].eqNullSafe(F.lit(2))), ("REVIEW_TYPE", ~a["review_type"].eqNullSafe(F.col("review_type"))), ("NO_EXPLANATION", e.isNull()),
        *[(f"NO_{t.upper()}", blank(e[t])) for t in ("summary", "cause", "scheduling")], ("SUMMARY_LENGTH", too_long(e["summary"], 180)),
        ("EXPLANATION_REFS", F.when(status == "NEED_MORE_CONTEXT", bad_refs(e["evidence_refs"], True)).otherwise(bad_refs(e["evidence_refs"]))),
        ("PARTICIPANTS", e["participants"].isNull()), ("PARTICIPANT_ID", some(actors, lambda p: blank(p["id"]) | too_long(p["id"], 80))), ("PARTICIPANT_TWICE", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("ELIGIBILITY", some(actors, lambda p: ~F.coalesce(p["eligibility"].isin("ACTUAL", "EXCLUDED", "UNKNOWN"), F.lit(False)))),
        ("PARTICIPANT_TEXT", some(actors, lambda p: blank(p["label"]) | blank(p["entry"]) | blank(p["access"]) | too_long(p["label"], 100) | too_long(p["entry"], 400) | too_long(p["access"], 400))),
        ("PARTICIPANT_REFS", some(actors, lambda p: bad_refs(p["evidence_refs"]))), ("SCENARIOS", scenarios.isNull()),
        ("SCENARIO_TEXT", some(scenarios, lambda s: blank(s["title"]) | blank(s["precondition"]) | blank(s["expected"]) | blank(s["actual"]))),
        ("SCENARIO_KIND", some(scenarios, lambda s: ~F.coalesce(s["kind"].isin("CONFLICT", "BLOCKED", "UNRESOLVED"), F.lit(False)) | ((status != "CONFIRMED") & (s["kind"] == "CONFLICT")) | (status.isin(SAFE) & (s["kind"] != "BLOCKED")))),
        ("STEPS", some(scenarios, lambda s: s["steps"].isNull())), ("STEP_ACTOR", steps(lambda s, t: blank(t["actor_id"]) | ~F.coalesce(F.array_contains(ids, t["actor_id"]), F.lit(False)))),
        ("STEP_NOT_ACTUAL", steps(lambda s, t: (s["kind"] == "CONFLICT") & ~F.coalesce(F.array_contains(actual, t["actor_id"]), F.lit(False)))),
        ("STEP_TEXT", steps(lambda s, t: blank(t["action"]) | blank(t["state_before"]) | blank(t["state_after"]) | too_long(t["action"], 400) | too_long(t["state_before"], 240) | too_long(t["state_after"], 240))),
        ("STEP_REFS", steps(lambda s, t: bad_refs(t["evidence_refs"]))),
        ("CONFLICT_STEPS", some(scenarios, lambda s: (s["kind"] == "CONFLICT") & ((F.size(s["steps"]) < 2) | (F.size(F.array_distinct(F.transform(s["steps"], lambda t: t["actor_id"]))) < 2)))),
        ("NO_CONFLICT", (a["review_type"] == "VARIABLE") & (status == "CONFIRMED") & ~F.get(scenarios, F.lit(0))["kind"].eqNullSafe(F.lit("CONFLICT"))), ("NO_BLOCKED", status.isin(SAFE) & (F.size(scenarios) == 0)),
        ("MISSING_EVIDENCE", missing.isNull() | some(missing, blank) | (status.isin("LIKELY", "NEED_MORE_CONTEXT") & (F.size(missing) == 0))),
    ]
    parsed = answers.withColumn("a", F.from_json("answer", ANSWER))
    return parsed.select("finding_id", F.coalesce(*[F.when(F.coalesce(hold, F.lit(False)), name) for name, hold in rules]).alias("problem"))


def snapshot_witness(accesses: DataFrame, snapshots: DataFrame, bindings: DataFrame, contexts: DataFrame) -> DataFrame:
    """symbol_id, main, read_id, rival, rival_id, write_id: a read in MAIN, an interrupt's write, and a later write in the same function and file of the same path.

    The first read by line that has both; the rival with the shortest chain,
    then the smallest context; the write with the smallest line. A conditional
    witness, no proof.
    """
    b = bindings.join(F.broadcast(contexts.select("context_id", "kind")), "context_id")
    mains = b.where("kind = 'MAIN'").groupBy("function_id").agg(F.min("context_id").alias("main"))
    place = ["symbol_id", "function_id", "file", "access_path"]
    read = accesses.where("access_kind = 'READ'").join(snapshots.select("symbol_id", "function_id").distinct(), ["symbol_id", "function_id"], "left_semi").join(mains, "function_id")
    read = read.groupBy(*place, "main", F.col("line").alias("read_line")).agg(F.min("access_id").alias("read_id"))
    write = accesses.where("access_kind = 'WRITE'").groupBy(*place, "line").agg(F.min("access_id").alias("write_id"))
    pair = read.join(write, place).where("line > read_line").groupBy(*place, "main", "read_line", "read_id").agg(F.min(F.struct("line", "write_id")).alias("w"))
    rival = accesses.where("access_kind in ('WRITE', 'RMW')").select("symbol_id", "access_path", "function_id", "access_id").join(b.where("kind = 'ISR'"), "function_id")
    rival = rival.groupBy("symbol_id", "access_path").agg(F.min(F.struct("call_depth", "context_id", "access_id")).alias("r"))
    both = pair.join(rival, ["symbol_id", "access_path"])
    first = both.groupBy("symbol_id").agg(F.min(F.struct("read_line", "read_id", "main", "r", "w")).alias("x"))
    return first.select("symbol_id", "x.main", "x.read_id", F.col("x.r.context_id").alias("rival"), F.col("x.r.access_id").alias("rival_id"), F.col("x.w.write_id").alias("write_id"))


def packet(findings: DataFrame, related: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """finding_id, n_functions, n_edges, n_lines: the related functions of each finding, the calls that touch them and their source lines."""
    f = related.join(functions.select("function_id", (F.col("end_line") - F.col("line") + 1).alias("n")), "function_id")
    own = f.groupBy("finding_id").agg(F.count("*").alias("n_functions"), F.sum("n").alias("n_lines"))
    ends = edges.select("caller", "callee", F.explode(F.array("caller", "callee")).alias("function_id"))
    calls = related.join(ends, "function_id").select("finding_id", "caller", "callee").distinct().groupBy("finding_id").agg(F.count("*").alias("n_edges"))
    return findings.select("finding_id").join(own, "finding_id", "left").join(calls, "finding_id", "left").fillna(0)
