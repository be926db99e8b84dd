"""The facts hold every row of the supplied tables: against brute force over all of them."""

import duckdb

from factgraph.sources.facts import fact

SF = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.connect().execute(sql.format(sf=SF)).fetchall()


def test_accesses_are_all_lines(spark):
    lines = set(rows("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM '{sf}/lineitem.parquet'"))
    got = {r.access_id for r in fact(spark, SF, "accesses").select("access_id").collect()}
    assert got == {"A" + ".".join(map(str, x)) for x in lines}


def test_calls_are_all_orders(spark):
    n, want = rows("SELECT count(*) FROM '{sf}/customer.parquet'")[0][0], set()
    name = lambda k: f"F{k:07d}"
    for key, owner in rows("SELECT o_orderkey, o_custkey FROM '{sf}/orders.parquet'"):
        k = owner + 1 + key % 3 * 7
        inside = k // 40 == owner // 40 and k < n
        want.add((name(owner), name(k) if inside else f"X{k % 50}"))
        if inside and owner % 20 == 10:
            want.add((name(k), name(owner)))
    assert {(r.caller, r.callee) for r in fact(spark, SF, "calls").select("caller", "callee").collect()} == want
