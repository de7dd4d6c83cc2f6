"""The driver-facing queries over the test tables, each with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderlog.runtime import Runtime
from cinderlog.sources.edges import table

# Base relations: name -> (tables read, SQL body). The dialects differ in integer division only.
EDB = {
    "nation": (["nation"], "SELECT CAST(n_nationkey AS BIGINT) a, n_name b, CAST(n_regionkey AS BIGINT) c FROM nation"),
    "region": (["region"], "SELECT CAST(r_regionkey AS BIGINT) a, r_name b FROM region"),
    "cust": (["customer"], "SELECT c_custkey a, CAST(c_nationkey AS BIGINT) b, c_mktsegment c FROM customer"),
    "supp": (["supplier"], "SELECT s_suppkey a, CAST(s_nationkey AS BIGINT) b FROM supplier"),
    "ord": (["orders"], "SELECT o_orderkey a, o_custkey b, o_orderstatus c FROM orders"),
    "cstat": (["orders"], "SELECT DISTINCT o_custkey a, o_orderstatus b FROM orders"),
    "li": (["lineitem"], "SELECT DISTINCT l_orderkey a, l_partkey b, l_suppkey c FROM lineitem"),
    "evt": (["events"], "SELECT DISTINCT user_id a, event_type b FROM events"),
    "parent": (["customer"], "SELECT c_custkey a, {half} b FROM customer WHERE c_custkey > 0"),
    # who came next, that day, after a user's last event of a type
    "follows": (
        ["events"],
        "SELECT DISTINCT user_id a, nxt b FROM (SELECT user_id, nxt, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) k "
        "FROM (SELECT *, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) nxt FROM events ) WHERE nxt IS NOT NULL) WHERE k = 1",
    ),
    # a supplier nation's main customer nation for each kind of line
    "trade": (
        ["lineitem", "orders", "customer", "supplier"],
        "SELECT DISTINCT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a, l_returnflag, l_linestatus ORDER BY n DESC, b) k FROM ("
        "SELECT CAST(s_nationkey AS BIGINT) a, CAST(c_nationkey AS BIGINT) b, l_returnflag, l_linestatus, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, c_nationkey, l_returnflag, l_linestatus)) WHERE k = 1",
    ),
    "rdf": (["customer"], "SELECT c_custkey a, CAST(2 AS BIGINT) b, {half} c FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, 1, CAST(c_nationkey AS BIGINT) FROM customer"),
}
HALF = {"spark": "c_custkey div 2", "duckdb": "c_custkey // 2"}


def edb(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables, body = EDB[name]
    frames = {t: table(spark, folder, t) for t in tables}
    sql = body.format(half=HALF["spark"])
    for t in tables:  # frames are bound by name, no temporary views are left behind
        sql = _bind(sql, t)
    return spark.sql(sql, **{f"t_{t}": df for t, df in frames.items()})


def _bind(sql: str, t: str) -> str:
    for word in ("FROM", "JOIN"):
        sql = sql.replace(f"{word} {t} ", f"{word} {{t_{t}}} ")
        if sql.endswith(f"{word} {t}"):
            sql = sql[: -len(t)] + f"{{t_{t}}}"
    return sql


TC = {
    "right": "tc(?x,?y) <- [{e}(?x,?y)], tc(?x,?z) <- [{e}(?x,?y), tc(?y,?z)]",
    "left": "tc(?x,?y) <- [{e}(?x,?y)], tc(?x,?z) <- [tc(?x,?y), {e}(?y,?z)]",
    "both": "tc(?x,?y) <- [{e}(?x,?y)], tc(?x,?z) <- [tc(?x,?y), tc(?y,?z)]",
}
TC_SQL = "tc AS (SELECT a, b FROM {e}_ UNION SELECT e.a, tc.b FROM {e}_ e JOIN tc ON e.b = tc.a)"

#: name -> (base relations, program, relation or query asked for, SQL, recursive CTE of the SQL)
RULES: dict[str, tuple[list[str], str, str, str, str]] = {
    "scan_project": (["nation"], "out(?k,?n) <- [nation(?k,?n,?r)]", "out", "SELECT DISTINCT a c0, b c1 FROM nation_", ""),
    "project_dedup": (["nation"], "out(?r) <- [nation(?k,?n,?r)]", "out", "SELECT DISTINCT c c0 FROM nation_", ""),
    "project_swap": (["parent"], "out(?y,?x) <- [parent(?x,?y)]", "out", "SELECT DISTINCT b c0, a c1 FROM parent_", ""),
    "head_constant": (["nation"], 'out(?k,"nation",1) <- [nation(?k,?n,?r)]', "out", "SELECT DISTINCT a c0, 'nation' c1, CAST(1 AS BIGINT) c2 FROM nation_", ""),
    "select_one_const": (["nation"], "out(?k,?n) <- [nation(?k,?n,1)]", "out", "SELECT DISTINCT a c0, b c1 FROM nation_ WHERE c = 1", ""),
    "select_two_const": (["cust"], 'out(?c) <- [cust(?c,3,"BUILDING")]', "out", "SELECT DISTINCT a c0 FROM cust_ WHERE b = 3 AND c = 'BUILDING'", ""),
    "repeated_var": (["trade"], "out(?x) <- [trade(?x,?x)]", "out", "SELECT DISTINCT a c0 FROM trade_ WHERE a = b", ""),
    "join2": (["cust", "nation"], "out(?c,?n) <- [cust(?c,?k,?s), nation(?k,?n,?r)]", "out", "SELECT DISTINCT c.a c0, n.b c1 FROM cust_ c JOIN nation_ n ON c.b = n.a", ""),
    "join3_chain": (["cust", "nation", "region"], "out(?c,?rn) <- [cust(?c,?k,?s), nation(?k,?n,?r), region(?r,?rn)]", "out",
        "SELECT DISTINCT c.a c0, r.b c1 FROM cust_ c JOIN nation_ n ON c.b = n.a JOIN region_ r ON n.c = r.a", ""),
    "join_multikey": (["li", "ord", "cust", "supp"], "out(?o,?s) <- [li(?o,?p,?s), ord(?o,?c,?st), cust(?c,?n,?g), supp(?s,?n)]", "out",
        "SELECT DISTINCT l.a c0, l.c c1 FROM li_ l JOIN ord_ o ON l.a = o.a JOIN cust_ c ON o.b = c.a JOIN supp_ s ON s.a = l.c AND s.b = c.b", ""),
    "star_join": (["evt"], 'out(?u) <- [evt(?u,"error"), evt(?u,"signup"), evt(?u,"click")]', "out",
        "SELECT a c0 FROM evt_ WHERE b = 'error' INTERSECT SELECT a FROM evt_ WHERE b = 'signup' INTERSECT SELECT a FROM evt_ WHERE b = 'click'", ""),
    "self_join_hop": (["trade"], "out(?x,?z) <- [trade(?x,?y), trade(?y,?z)]", "out", "SELECT DISTINCT x.a c0, y.b c1 FROM trade_ x JOIN trade_ y ON x.b = y.a", ""),
    "cross_product": (["region", "nation"], "out(?r,?k) <- [region(?r,?rn), nation(?k,?n,?q)]", "out", "SELECT DISTINCT r.a c0, n.a c1 FROM region_ r CROSS JOIN nation_ n", ""),
    "union_rules": (["trade"], "out(?x) <- [trade(?x,?y)], out(?y) <- [trade(?x,?y)]", "out", "SELECT a c0 FROM trade_ UNION SELECT b FROM trade_", ""),
    "intersection": (["trade"], "back(?y,?x) <- [trade(?x,?y)], out(?x,?y) <- [trade(?x,?y), back(?x,?y)]", "out", "SELECT a c0, b c1 FROM trade_ INTERSECT SELECT b, a FROM trade_", ""),
    "semi_join": (["cust", "cstat"], 'out(?c) <- [cust(?c,?n,?s), cstat(?c,"F")]', "out", "SELECT DISTINCT a c0 FROM cust_ WHERE a IN (SELECT a FROM cstat_ WHERE b = 'F')", ""),
    "anti_join": (["nation", "trade"], "out(?x,?y) <- [nation(?x,?a,?b), nation(?y,?c,?d), !trade(?x,?y)]", "out",
        "SELECT x.a c0, y.a c1 FROM nation_ x CROSS JOIN nation_ y EXCEPT SELECT a, b FROM trade_", ""),
    "anti_join_const": (["cust", "cstat"], 'out(?c) <- [cust(?c,?n,?s), !cstat(?c,"F")]', "out", "SELECT DISTINCT a c0 FROM cust_ WHERE a NOT IN (SELECT a FROM cstat_ WHERE b = 'F')", ""),
    "tc_right_linear": (["parent"], TC["right"].format(e="parent"), "tc", "SELECT a c0, b c1 FROM tc", "parent"),
    "tc_left_linear": (["parent"], TC["left"].format(e="parent"), "tc", "SELECT a c0, b c1 FROM tc", "parent"),
    "tc_nonlinear": (["parent"], TC["both"].format(e="parent"), "tc", "SELECT a c0, b c1 FROM tc", "parent"),
    "tc_cyclic": (["follows"], TC["both"].format(e="follows"), "tc", "SELECT a c0, b c1 FROM tc", "follows"),
    "strata_base_derived_top": (["trade"],
        "base(?x,?y) <- [trade(?x,?y)], derived(?x,?y) <- [base(?x,?y)], derived(?x,?z) <- [derived(?x,?y), base(?y,?z)], top(?x,?z) <- [derived(?x,?y), base(?y,?z)]", "top",
        "SELECT DISTINCT tc.a c0, t.b c1 FROM tc JOIN trade_ t ON tc.b = t.a", "trade"),
    "mutual_recursion": (["parent"], "even(0) <- [], odd(?x) <- [parent(?x,?y), even(?y)], even(?x) <- [parent(?x,?y), odd(?y)]", "even",
        "SELECT DISTINCT a c0 FROM p WHERE par = 0", "p AS (SELECT CAST(0 AS BIGINT) a, 0 par UNION SELECT e.a, 1 - p.par FROM parent_ e JOIN p ON e.b = p.a)"),
    "const_in_recursion": (["rdf", "parent"], "t(?s,?p,?o) <- [rdf(?s,?p,?o)], t(?x,2,?z) <- [t(?x,2,?y), t(?y,2,?z)]", "t",
        "SELECT a c0, b c1, c c2 FROM rdf_ UNION SELECT a, 2, b FROM tc", "parent"),
    "query_pattern_const": (["parent"], TC["right"].format(e="parent"), "tc(_, 5)", "SELECT a c0, b c1 FROM tc WHERE b = 5", "parent"),
    "stratified_negation": (["trade", "nation"], TC["right"].format(e="trade") + ", out(?x,?y) <- [nation(?x,?a,?b), nation(?y,?c,?d), !tc(?x,?y)]", "out",
        "SELECT x.a c0, y.a c1 FROM nation_ x CROSS JOIN nation_ y EXCEPT SELECT a, b FROM tc", "trade"),
}

SG = "sg(?x,?y) <- [parent(?x,?p), parent(?y,?p)], sg(?x,?y) <- [parent(?x,?u), sg(?u,?v), parent(?y,?v)]"
SG_SQL = ("sg AS (SELECT x.a, y.a b FROM parent_ x JOIN parent_ y ON x.b = y.b UNION "
          "SELECT u.a, d.a FROM parent_ u JOIN sg ON u.b = sg.a JOIN parent_ d ON d.b = sg.b)")

#: goal-directed queries: name -> (base relations, program, query, SQL, recursive CTE)
GOALS: dict[str, tuple[list[str], str, str, str, str]] = {
    "magic_bf": (["parent"], TC["right"].format(e="parent"), "tc(1000, _)", "SELECT a c0, b c1 FROM tc WHERE a = 1000", "parent"),
    "magic_fb": (["parent"], TC["right"].format(e="parent"), "tc(_, 5)", "SELECT a c0, b c1 FROM tc WHERE b = 5", "parent"),
    "magic_bb": (["parent"], TC["right"].format(e="parent"), "tc(1000, 125)", "SELECT a c0, b c1 FROM tc WHERE a = 1000 AND b = 125", "parent"),
    "magic_ff": (["trade"], TC["right"].format(e="trade"), "tc(_, _)", "SELECT a c0, b c1 FROM tc", "trade"),
    "magic_same_generation": (["parent"], SG, "sg(700, _)", "SELECT a c0, b c1 FROM sg WHERE a = 700", SG_SQL),
}


def _sql(relations: list[str], body: str, recursive: str) -> str:
    ctes = [f"{r}_ AS ({EDB[r][1].format(half=HALF['duckdb'])})" for r in relations]
    if recursive:
        ctes.append(recursive if " AS " in recursive else TC_SQL.format(e=recursive))
    return f"WITH RECURSIVE {', '.join(ctes)} {body}"


def _runtime(spark: SparkSession, folder: str, relations: list[str], program: str) -> Runtime:
    rt = Runtime(spark, program)
    used = {a.symbol for r in rt.program for a in r.body}
    for r in relations:
        if r in used:
            rt.insert_df(r, edb(spark, folder, r))
    return rt


def _rule_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    relations, program, ask, _, _ = RULES[name]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rt = _runtime(spark, folder, relations, program)
        rt.poll()
        return rt.query(ask) if "(" in ask else rt.df(ask)

    return run


def _goal_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    relations, program, ask, _, _ = GOALS[name]
    return lambda spark, folder: _runtime(spark, folder, relations, program).query_program(ask)


def incremental_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Two inserts with a poll after each; the second derives only what uses a new fact."""
    rt = Runtime(spark, TC["right"].format(e="parent"))
    parent = edb(spark, folder, "parent")
    rt.insert_df("parent", parent.filter("a < 700"))
    rt.poll()
    rt.insert_df("parent", parent.filter("a >= 700"))
    rt.poll()
    return rt.df("tc")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _rule_query(n) for n in RULES} | {n: _goal_query(n) for n in GOALS} | {"incremental_insert": incremental_insert}


def oracle_sql() -> dict[str, str]:
    out = {n: _sql(x[0], x[3], x[4]) for n, x in (RULES | GOALS).items()}
    return out | {"incremental_insert": _sql(["parent"], "SELECT a c0, b c1 FROM tc", "parent")}
