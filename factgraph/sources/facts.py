"""Program facts derived from the supplied tables. These are synthetic analogues: they carry no meaning of real firmware.

Each fact is one SQL text over whole tables and other facts, named in braces;
Spark and the SQL of the queries read the same text, so that both start from
the same rows. Functions come in blocks of 40: calls stay inside a block or go
to undefined code, which leaves acyclic parts, cycles, entries and dead parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

F_ID = "'F' || lpad(CAST({0} AS STRING), 7, '0')"


def _f(key: str) -> str:
    return F_ID.format(key)


def _call(columns: str, back: bool = False) -> str:
    inside = "floor((o_custkey + 1 + (o_orderkey % 3) * 7) / 40) = floor(o_custkey / 40) AND o_custkey + 1 + (o_orderkey % 3) * 7 < n"
    return f"SELECT DISTINCT {columns} FROM (SELECT o_custkey, o_orderkey, o_custkey + 1 + (o_orderkey % 3) * 7 AS k, {inside} AS inside FROM {{orders}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c) o{' WHERE inside AND o_custkey % 20 = 10' if back else ''}"


SQL = {
    "variables": """SELECT 'P' || CAST(p_partkey AS STRING) AS symbol_id, p_partkey AS no, 'v' || CAST(p_partkey AS STRING) AS name, 'n' || CAST(p_partkey % 25 AS STRING) || '::v' || CAST(p_partkey AS STRING) AS qualified_name,
  CASE p_partkey % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'FILE_STATIC' ELSE 'LOCAL_STATIC' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'EXTERNAL' ELSE 'INTERNAL' END AS linkage, p_type AS type,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS size_bytes, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 4) * 2 END AS alignment_bytes, p_partkey % 19 = 0 AS is_const, p_partkey % 11 = 0 AS is_struct, p_partkey % 23 = 0 AS is_bitfield_container,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE lower(replace(p_brand, '#', '')) || '/p' || CAST(p_partkey % 50 AS STRING) || '.c' END AS definition_file, p_partkey % 400 + 1 AS definition_line,
  lower(replace(p_brand, '#', '')) || '/inc/p' || CAST(p_partkey % 10 AS STRING) || '.h' AS declaration_file, CASE WHEN p_partkey % 41 = 0 THEN 'supplemental' WHEN p_partkey % 43 = 0 THEN 'inactive_branch' ELSE 'compile_database' END AS coverage_source,
  CASE WHEN p_partkey % 97 = 0 THEN 'FAILED' ELSE 'PARSED' END AS parse_status FROM {part}
  UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), s_suppkey, 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey AS STRING), 'GLOBAL', CASE WHEN s_suppkey % 2 = 0 THEN 'EXTERNAL' ELSE 'INTERNAL' END, 'int', CAST(4 AS BIGINT), CAST(4 AS BIGINT), s_suppkey % 3 = 0, false, false, 'sup/s.c', s_suppkey + 1, 'sup/s.h', 'compile_database', 'PARSED' FROM {supplier}""",
    "functions": f"""SELECT {_f('c_custkey')} AS function_id, c_custkey AS no, CASE WHEN c_custkey % 40 = 5 THEN 'T' || CAST(c_custkey AS STRING) || '_IRQHandler' WHEN c_custkey % 200 = 9 THEN 'main' WHEN c_custkey % 40 = 13 THEN 'HAL_' || CAST(c_custkey AS STRING) || '_IRQHandler' WHEN c_custkey % 200 = 17 THEN 'SysTick_Handler' ELSE 'f' || CAST(c_custkey AS STRING) END AS name,
  'n' || CAST(c_nationkey AS STRING) || '::f' || CAST(c_custkey AS STRING) AS qualified_name, 'n' || CAST(c_nationkey AS STRING) || '/f' || CAST(c_custkey % 4 AS STRING) || '.c' AS file, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 40 > 5 THEN 'EXTERNAL' ELSE 'INTERNAL' END AS linkage, c_custkey % 3 AS parameter_count,
  c_custkey % 300 * 10 + 1 AS line, c_custkey % 300 * 10 + 1 + c_custkey % 17 * 60 AS end_line, c_custkey % 389 = 1 AS attributed FROM {{customer}}""",
    "accesses": f"""SELECT DISTINCT 'A' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS access_id, 'P' || CAST(l_partkey AS STRING) AS symbol_id,
  CASE WHEN l_partkey % 6 = 1 THEN {_f('l_partkey % n')} WHEN l_partkey % 6 < 4 THEN {_f('(l_partkey + l_suppkey % 3) % n')} ELSE {_f('o_custkey')} END AS function_id,
  CASE WHEN l_partkey % 5 = 0 OR l_returnflag = 'R' THEN 'READ' WHEN l_returnflag = 'A' THEN 'WRITE' WHEN l_linestatus = 'F' THEN 'RMW' WHEN l_partkey % 7 = 0 THEN 'ADDRESS_TAKEN' ELSE 'READ' END AS access_kind,
  'a' || CAST(l_suppkey % 9 AS STRING) || '.c' AS file, CAST(l_linenumber AS BIGINT) * 20 + l_orderkey % 300 AS line, CASE WHEN l_partkey % 6 = 1 AND l_partkey % 4 = 1 THEN 1 ELSE l_orderkey END AS pos, CASE WHEN l_suppkey % 4 = 0 THEN '/f' || CAST(l_suppkey % 3 AS STRING) ELSE '' END AS access_path, l_partkey % 13 = 0 AND l_linenumber = 1 AS via_alias
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c""",
    "calls": _call(f"""{_f('o_custkey')} AS caller, CASE WHEN inside THEN {_f('k')} ELSE 'X' || CAST(k % 50 AS STRING) END AS callee, CASE WHEN inside THEN 'f' || CAST(k AS STRING) WHEN k % 5 = 0 THEN 'memcpy' ELSE 'ext' || CAST(k % 50 AS STRING) END AS callee_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'INDIRECT' WHEN o_orderkey % 4 = 1 THEN 'INDIRECT_RESOLVED' ELSE 'DIRECT' END AS call_kind, 'a' || CAST(o_custkey % 9 AS STRING) || '.c' AS file, o_orderkey % 20 AS line""") + " UNION ALL " + _call(f"{_f('k')}, {_f('o_custkey')}, 'f' || CAST(o_custkey AS STRING), 'DIRECT', 'a' || CAST(k % 9 AS STRING) || '.c', CAST(7 AS BIGINT)", True),
    "contexts": "SELECT 'C' || CAST(r_regionkey AS STRING) AS context_id, CASE r_regionkey WHEN 0 THEN 'ISR' WHEN 1 THEN 'TASK' WHEN 2 THEN 'MAIN' WHEN 3 THEN 'CALLBACK' ELSE 'DMA' END AS kind, r_regionkey = 3 AS reentrant FROM {region}",
    "roots": f"SELECT 'C' || CAST(n_regionkey AS STRING) AS context_id, {_f('c_custkey')} AS function_id FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 8 = 3",
    "unknowns": f"""SELECT event_id AS unknown_no, CASE event_id % 6 WHEN 0 THEN 'FUNCTION_ADDRESS' WHEN 1 THEN 'INDIRECT_CALL' WHEN 2 THEN 'UNRESOLVED_POINTEE' WHEN 3 THEN 'POINTER_DEREFERENCE' WHEN 4 THEN 'ADDRESS_ESCAPE' ELSE 'DMA_SHARED_REVIEW' END AS kind,
  CASE WHEN event_id % 6 >= 4 THEN 'P' || CAST(event_id % 97 * 13 AS STRING) END AS symbol_id, {_f('user_id')} AS function_id, CASE WHEN event_id % 6 = 0 AND user_id % 5 = 0 THEN {_f('user_id + 10')} END AS target_function_id,
  'a' || CAST(user_id % 9 AS STRING) || '.c' AS file, event_id % 100 AS line FROM {{events}}""",
    "protection_events": f"SELECT event_id AS event_no, {_f('user_id * 7 % 1000')} AS function_id, CASE event_type WHEN 'click' THEN 'lock_enter' WHEN 'view' THEN 'lock_exit' ELSE 'dma_start' END AS event_kind FROM {{events}}",
    "snapshots": "SELECT DISTINCT symbol_id, function_id FROM {accesses} WHERE access_kind = 'READ' AND CAST(substr(symbol_id, 2) AS BIGINT) % 9 = 0",
    "resources": "SELECT 'P' || CAST(s_suppkey * 3 AS STRING) AS resource, 'C' || CAST(s_suppkey % 5 AS STRING) AS owner_context, s_suppkey % 2 = 0 AS business_critical FROM {supplier}",
    "protection": "SELECT 'v' || CAST(s_suppkey * 5 AS STRING) AS resource FROM {supplier}",
    "variable_parts": """SELECT 'P' || CAST(p_partkey AS STRING) AS symbol_id, 0 AS part_ord, p_brand AS kind, CAST(p_size AS BIGINT) AS size_bytes, substr(p_type, 1, 3) AS type, p_partkey % 3 <> 0 AS defined, p_partkey % 97 = 0 AS parse_failed, 'd' || CAST(p_partkey % 5 AS STRING) || '.h' AS declaration FROM {part}
  UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), 1, p_brand, CAST(p_size AS BIGINT) + 1, substr(p_type, 1, 5), true, p_partkey % 89 = 0, 'd' || CAST(p_partkey % 3 AS STRING) || '.h' FROM {part} WHERE p_partkey % 2 = 0""",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return table(spark, sf_dir, name)
    used = set(re.findall(r"\{(\w+)\}", SQL[name]))
    return spark.sql(SQL[name], **{u: fact(spark, sf_dir, u) for u in used})


def with_facts(*names: str) -> str:
    """The facts as common table expressions, each after those that it needs."""
    out: dict[str, str] = {}

    def add(name):
        if name in SQL and name not in out:
            for used in re.findall(r"\{(\w+)\}", SQL[name]):
                add(used)
            out[name] = re.sub(r"\{(\w+)\}", r"\1", SQL[name]).replace("{{", "{").replace("}}", "}")

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in out.items())

NL = "chr(10)"
SQL |= {
    "findings": """SELECT 'G' || CAST(p_partkey AS STRING) AS finding_id, CASE WHEN p_partkey % 9 <> 0 THEN 'P' || CAST(p_partkey - p_partkey % 2 AS STRING) END AS symbol_id, 'v' || CAST(p_partkey % 700 AS STRING) AS variable_name,
  CASE p_partkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE p_partkey % 5 WHEN 0 THEN 'GS-MULTI-CONTEXT,GS-TEAR-RISK' WHEN 1 THEN 'GS-UNKNOWN-CONTEXT' WHEN 2 THEN 'GS-MULTI-CONTEXT,GS-MULTI-WRITER,GS-STALE-SNAPSHOT' WHEN 3 THEN 'GS-DEFINITION-MISSING' ELSE 'DMA_SHARED_REVIEW' END AS rule_list FROM {part}""",
    "review_events": """SELECT 'G' || CAST(event_id * 7 % n AS STRING) AS finding_id, event_id AS seq, event_id % 2 AS pass, CASE user_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' ELSE 'DONE' END AS state,
  CASE event_id % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'LIKELY' WHEN 2 THEN 'REVIEWED_SAFE' WHEN 3 THEN 'FALSE_POSITIVE' ELSE 'NEED_MORE_CONTEXT' END AS status, 'fp' || CAST(event_id % 3 AS STRING) AS scan_fingerprint, 'k' || CAST(event_id % 11 AS STRING) AS cache_key
  FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {part}) p""",
    "registrations": f"""SELECT c_custkey AS ord, CASE WHEN c_custkey % 37 = 0 THEN 'X' || CAST(c_custkey AS STRING) ELSE {_f('c_custkey * 3 % n')} END AS function_id, 'r' || CAST(c_custkey % 5 AS STRING) || '.c' AS file, c_custkey % 3 AS pos,
  CASE c_custkey % 5 WHEN 0 THEN 'TASK' WHEN 1 THEN 'ISR' WHEN 2 THEN 'CALLBACK' WHEN 3 THEN 'TIMER' ELSE 'DEFERRED' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN 'G' || CAST(c_custkey % 28 AS STRING) END AS given_id, c_custkey % 4 = 0 AS configured, c_custkey % 3 = 0 AS may_repeat
  FROM {{customer}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c""",
    "sources": f"""SELECT 'o' || CAST(o_orderkey AS STRING) AS file, o_orderkey % 4 AS shape, 'G' || CAST(o_orderkey AS STRING) AS guard, '#ifndef G' || CAST(o_orderkey AS STRING) || {NL} || '#define G' || CAST(o_orderkey AS STRING) || {NL} || CASE o_orderkey % 4
  WHEN 0 THEN '#if A' || {NL} || 'int a;' || {NL} || '# elif B' || {NL} || 'int b;' || {NL} || '#else' || {NL} || 'int c;' || {NL} || '#endif' WHEN 1 THEN '#if A' || {NL} || '#ifdef B' || {NL} || 'int b;' || {NL} || '#endif' || {NL} || '#endif'
  WHEN 2 THEN '/* #if X */' || {NL} || 'int d; // #endif' ELSE '#if A' || {NL} || 'int e;' END || {NL} || '#endif' AS text FROM {{orders}}""",
    "assembly": f"""SELECT 'e' || CAST(event_id AS STRING) AS file, CASE WHEN event_id % 50 = 0 THEN '.macro m' || {NL} ELSE '' END || 'LDR r0, =v' || CAST(event_id % 3000 AS STRING) || ' ; v' || CAST(event_id % 3000 AS STRING) || {NL} || 'BL f' || CAST(event_id % 2000 AS STRING) AS text, event_id FROM {{events}}""",
    "logs": f"""SELECT 'L' || CAST(event_id AS STRING) AS finding_id, '{{{{"type":"text","part":{{{{"text":"a' || CAST(event_id AS STRING) || '"}}}}}}}}' || {NL} || CASE WHEN event_id % 7 = 0 THEN '{{{{"type":"error"}}}}' ELSE 'not json' END || {NL} || '{{{{"type":"text","part":{{{{"text":"b"}}}}}}}}' AS log, event_id FROM {{events}}""",
    "answers": f"""SELECT 'Q' || CAST(o_orderkey AS STRING) AS finding_id, CASE o_orderkey % 4 WHEN 0 THEN '```json' || {NL} || '{{{{"finding_id":"Q' || CAST(o_orderkey AS STRING) || '"}}}}' || {NL} || '```' WHEN 1 THEN 'See ```json {{{{"a":1}}}} ``` and ```json {{{{"a":2}}}} ``` there' WHEN 2 THEN 'so {{{{ it }}}} is {{{{"finding_id":"Q' || CAST(o_orderkey AS STRING) || '"}}}}' ELSE 'nothing' END AS answer, o_orderkey FROM {{orders}}""",
    "syntax": """SELECT l_orderkey * 1000 + l_partkey * 10 + l_linenumber AS ref, CAST(l_quantity AS BIGINT) % 4 AS distance, CASE l_suppkey % 6 WHEN 0 THEN 'SIZEOF' WHEN 1 THEN 'UNARY' WHEN 2 THEN 'BINARY' WHEN 3 THEN 'CALL' WHEN 4 THEN 'DECAY' ELSE 'MEMBER' END AS kind,
  CASE l_linenumber WHEN 1 THEN '++' WHEN 2 THEN '&' WHEN 3 THEN '=' WHEN 4 THEN '+=' ELSE '-' END AS op, l_partkey % 2 AS child, l_partkey % 3 = 0 AS same_symbol, l_partkey % 5 = 0 AS is_array FROM {lineitem}""",
    "arguments": """SELECT o_orderkey AS site, CASE o_orderkey % 6 WHEN 0 THEN 'memcpy' WHEN 1 THEN 'memset' WHEN 2 THEN 'HAL_UART_Receive_DMA' WHEN 3 THEN 'HAL_SPI_Transmit_DMA' WHEN 4 THEN 'my_dma_start' ELSE 'xTaskCreate' END AS name, CAST(o_orderkey % 3 AS INT) AS arg, 'obj:P' || CAST(o_custkey AS STRING) AS location FROM {orders}""",
    "locations": "SELECT DISTINCT 'obj:P' || CAST(l_partkey AS STRING) || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/f' || CAST(l_suppkey AS STRING) ELSE '/a/b' END AS location FROM {lineitem}",
    "units": """SELECT o_custkey AS tu, 'u' || CAST(o_orderkey % 400 AS STRING) || '.c' AS file, 'h' || CAST(o_orderkey % 50 AS STRING) || '.h' AS header, CASE WHEN o_orderkey % 23 = 0 THEN 'FAILED' ELSE 'PARSED' END AS parse_status FROM {orders}""",
    "files": "SELECT DISTINCT CASE l_suppkey % 3 WHEN 0 THEN 'u' || CAST(l_partkey % 500 AS STRING) || '.c' WHEN 1 THEN 'h' || CAST(l_partkey % 60 AS STRING) || '.H' ELSE CASE WHEN l_partkey % 2 = 0 THEN '.git/x' ELSE 'doc/x' END || CAST(l_partkey % 90 AS STRING) || CASE WHEN l_partkey % 4 = 0 THEN '.c' ELSE '.txt' END END AS file FROM {lineitem}",
    "declared": "SELECT l_orderkey AS function_id, 'n' || CAST(l_linenumber AS STRING) AS name, l_partkey * 1000 + l_suppkey AS pos FROM {lineitem}",
    "supplemental": "SELECT o_orderkey AS ord, 'P' || CAST(o_orderkey % 5000 AS STRING) AS symbol_id, 'v' || CAST(o_orderkey % 5000 AS STRING) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'FILE_STATIC' ELSE 'LOCAL_STATIC' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN 'sup/s.c' ELSE 'brand' || CAST(o_custkey % 25 AS STRING) || '/x.c' END AS file, o_orderkey % 400 + 1 AS line FROM {orders}",
    "linked": "SELECT 'core' || CAST(p_partkey % 2 AS STRING) AS variant, 'P' || CAST(p_partkey - p_partkey % 2 AS STRING) AS symbol_id, 'v' || CAST(p_partkey - p_partkey % 2 AS STRING) AS name, 'd/x' || CAST(p_partkey % 7 AS STRING) || '.c' AS definition_file FROM {part}",
    "elf": """SELECT 'core' || CAST(p_partkey % 2 AS STRING) AS path, 2 * p_partkey + 1 AS ord, 'v' || CAST(p_partkey - p_partkey % 2 AS STRING) AS name, (p_partkey - p_partkey % 2) * 16 AS address, CAST(p_size % 16 AS BIGINT) AS size, p_partkey % 3 AS binding, 1 AS type, p_partkey % 17 <> 0 AS defined FROM {part}
  UNION ALL SELECT 'core' || CAST(p_partkey % 2 AS STRING), 2 * p_partkey, 'x' || CAST(p_partkey % 7 AS STRING) || '.c', 0, 0, 0, 4, true FROM {part} WHERE p_partkey % 5 <> 0""",
    "function_parts": "SELECT 'F' || CAST(c_custkey AS STRING) AS function_id, CAST(c_nationkey % 3 AS BIGINT) AS part_ord, c_name AS name, c_mktsegment AS file FROM {customer} UNION ALL SELECT 'F' || CAST(c_custkey AS STRING), CAST(10 + c_custkey % 2 AS BIGINT), 'last', CAST(c_custkey % 9 AS STRING) FROM {customer} WHERE c_custkey % 3 = 0",
    "line_groups": f"SELECT 'P' || CAST(l_partkey AS STRING) AS group_id, {_f('o_custkey')} AS function_id, max(o_custkey % 17 * 60 + 1) AS n_lines FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "investigations": "SELECT 'G' || CAST(l_partkey AS STRING) AS finding_id, 'access:' || CAST(l_suppkey AS STRING) AS id, CASE WHEN l_orderkey % 31 = 0 THEN ' ' ELSE 'ok' END AS assessment, CAST(l_linenumber AS INT) AS cited FROM {lineitem} WHERE l_linenumber <> 3",
    "ancestors": """SELECT l_orderkey AS ref, CAST(l_linenumber AS INT) AS distance, CASE min(l_suppkey) % 11 WHEN 0 THEN 'WRAPPER' WHEN 1 THEN 'WRAPPER' WHEN 2 THEN 'WRAPPER' WHEN 3 THEN 'MEMBER' WHEN 4 THEN 'MEMBER' WHEN 5 THEN 'SUBSCRIPT' WHEN 6 THEN 'UNARY' WHEN 7 THEN 'BINARY' WHEN 8 THEN 'CALL' WHEN 9 THEN 'SIZEOF' ELSE 'RETURN' END AS kind,
  CASE min(l_partkey) % 6 WHEN 0 THEN '++' WHEN 1 THEN '&' WHEN 2 THEN '=' WHEN 3 THEN '+=' WHEN 4 THEN '*' ELSE '-' END AS op, CAST(min(l_partkey) % 5 % 2 AS INT) AS child, min(l_partkey) % 4 = 0 AS same_symbol, l_orderkey % 5 < 2 AS is_array, min(l_suppkey) % 11 = 1 AS decays, min(l_partkey) % 7 = 0 AS arrow, 'm' || CAST(min(l_suppkey) % 9 AS STRING) AS name FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # Compile commands with quotes, escapes, nested response files, and three kinds that cannot be used.
    "compile_entries": """SELECT o_orderkey AS tu, '../src/f' || CAST(o_orderkey AS STRING) || '.c' AS file, '/w/build' AS directory, CASE WHEN o_orderkey % 3 = 0 THEN 'ccache ' ELSE '' END || CASE WHEN o_orderkey % 5 = 2 THEN '/opt/arm-none-eabi-gcc' ELSE 'gcc' END || ' -c -o x.o -MFdep ' || CASE o_orderkey % 5 WHEN 0 THEN '"-DN=a b"' WHEN 1 THEN chr(39) || '-DQ="q"' || chr(39) || ' x' || chr(92) || chr(92) || 'y' ELSE '-I' || CAST(o_orderkey AS STRING) END
  || ' -g ' || CASE o_orderkey % 11 WHEN 7 THEN '"open' WHEN 8 THEN '@loop.rsp' WHEN 9 THEN '@./none.rsp' ELSE '@r' || CAST(o_orderkey % 7 AS STRING) || '.rsp' END || ' -DEND ../src/f' || CAST(o_orderkey AS STRING) || '.c' AS command FROM {orders}""",
    "configs": """SELECT c_custkey AS config_id, '{{"version":' || CASE c_custkey % 10 WHEN 9 THEN '2' ELSE '1' END || ',"contexts":[{{"id":"a","kind":"ISR"}},{{"id":"' || CASE c_custkey % 10 WHEN 1 THEN 'a' ELSE 'b' END || '","kind":"' || CASE c_custkey % 10 WHEN 2 THEN 'X' ELSE 'TASK' END || '"}}],"preemption":[{{"higher":"a","lower":"' || CASE c_custkey % 10 WHEN 3 THEN 'z' ELSE 'b' END
  || '"}}],"entry_registrations":[{{"api":"r*","callback_arg":' || CASE c_custkey % 10 WHEN 4 THEN '-1' ELSE '0' END || ',"kind":"ISR","context_id":"' || CASE c_custkey % 10 WHEN 5 THEN 'b' ELSE 'a' END || '"}}],"review":{{"workers":' || CASE c_custkey % 10 WHEN 6 THEN '9' ELSE '2' END || '}},"project":{{"native_word_bits":' || CASE c_custkey % 10 WHEN 7 THEN '12' ELSE '32' END
  || '}},"analysis":{{"include_dirs":["' || CASE c_custkey % 10 WHEN 8 THEN 'src*' ELSE c_name END || '"]}}}}' AS config FROM {customer}""",
    # Pointer facts: blocks of 40 functions share a slot of callbacks, which may hold a function of the next block too; ten blocks follow one another so.
    "constraints": f"""SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN '{{{{"op":"field","base":{{{{"op":"loc","id":"obj:S' || CAST(floor(c_custkey / 40) AS BIGINT) || '"}}}},"field":"cb"}}}}' WHEN 5 THEN '{{{{"op":"loc","id":"obj:S' || CAST(floor(c_custkey / 40) AS BIGINT) || '"}}}}'
  WHEN 2 THEN '{{{{"op":"loc","id":"' || {_f('c_custkey')} || ':local"}}}}' WHEN 3 THEN '{{{{"op":"deref","value":{{{{"op":"loc","id":"' || {_f('c_custkey')} || ':param:0"}}}}}}}}' ELSE '{{{{"op":"loc","id":"' || {_f('c_custkey')} || ':return"}}}}' END AS lhs,
  CASE c_custkey % 10 WHEN 0 THEN '{{{{"op":"function","id":"' || CASE WHEN c_custkey % 40 = 30 AND c_custkey + 40 < n AND floor(c_custkey / 400) = floor((c_custkey + 40) / 400) THEN {_f('c_custkey + 40')} ELSE {_f('c_custkey')} END || '"}}}}' WHEN 5 THEN '{{{{"op":"union","items":[{{{{"op":"function","id":"' || {_f('c_custkey')} || '"}}}},{{{{"op":"addr","value":{{{{"op":"loc","id":"obj:P' || c_custkey || '"}}}}}}}}]}}}}'
  WHEN 2 THEN '{{{{"op":"loc","id":"' || {_f('c_custkey')} || ':param:0"}}}}' WHEN 3 THEN '{{{{"op":"addr","value":{{{{"op":"loc","id":"obj:P' || c_custkey || '"}}}}}}}}' ELSE '{{{{"op":"loc","id":"' || {_f('c_custkey')} || ':param:0"}}}}' END AS rhs FROM {{customer}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c""",
    "semantic_calls": f"""SELECT o_orderkey AS site, {_f('o_custkey')} AS function_id, CASE WHEN shape = 0 THEN 'xTaskCreate' WHEN shape = 1 THEN 'my_register' WHEN shape = 2 THEN 'xTimerCreate' WHEN shape < 12 THEN 'memcpy' WHEN shape < 16 THEN 'HAL_UART_Receive_DMA' WHEN shape < 100 THEN 'call' ELSE 'f' END AS name, CASE WHEN shape >= 100 THEN {_f('callee')} END AS target,
  CASE WHEN shape BETWEEN 16 AND 99 THEN '{{{{"op":"field","base":{{{{"op":"loc","id":"' || slot || '"}}}},"field":"cb"}}}}' END AS expression,
  CASE WHEN shape = 0 THEN array(fn) WHEN shape = 1 THEN array(obj, '{{{{"op":"loc","id":"' || slot || '"}}}}') WHEN shape = 2 THEN array(obj, obj, obj, obj, fn) WHEN shape < 12 THEN array(obj, '{{{{"op":"addr","value":{{{{"op":"field","base":{{{{"op":"loc","id":"obj:P' || o_custkey || '"}}}},"field":"x"}}}}}}}}') WHEN shape < 16 THEN array(fn, obj) ELSE array(obj) END AS arguments,
  CASE WHEN shape >= 16 THEN '{{{{"op":"loc","id":"' || {_f('o_custkey')} || ':got"}}}}' END AS result, 'a' || CAST(o_custkey % 9 AS STRING) || '.c' AS file, CAST(o_orderkey % 300 AS BIGINT) AS line, o_orderkey AS pos
  FROM (SELECT o_orderkey, o_custkey, o_orderkey % 600 AS shape, o_custkey - o_custkey % 40 + o_orderkey % CASE WHEN o_custkey - o_custkey % 40 + 40 > n THEN n % 40 ELSE 40 END AS callee, 'obj:S' || CAST(floor(o_custkey / 40) AS BIGINT) AS slot,
  '{{{{"op":"function","id":"' || {_f('(o_custkey * 7 + 3) % n')} || '"}}}}' AS fn, '{{{{"op":"addr","value":{{{{"op":"loc","id":"obj:P' || o_orderkey % 1000 || '"}}}}}}}}' AS obj FROM {{orders}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c) o""",
    "indirect_accesses": f"""SELECT c_custkey AS item, {_f('c_custkey')} AS function_id, '{{{{"op":"deref","value":{{{{"op":"loc","id":"' || {_f('c_custkey')} || CASE WHEN c_custkey % 4 = 0 THEN ':got"}}}}}}}}' ELSE ':param:0"}}}}}}}}' END AS location, CASE c_custkey % 3 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' ELSE 'RMW' END AS mode,
  'a' || CAST(c_custkey % 9 AS STRING) || '.c' AS file, CAST(c_custkey % 300 AS BIGINT) AS line, c_custkey AS pos FROM {{customer}}""",
    "investigated": "SELECT DISTINCT 'G' || CAST(l_partkey AS STRING) AS finding_id, 'access:' || CAST(l_suppkey AS STRING) AS id FROM {lineitem} WHERE l_linenumber <> 4",
}
