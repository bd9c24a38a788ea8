import random

import pytest
from conftest import bag
from pyspark.sql import functions as F

from tablemill.functions.text import snake_case, table_identifier
from tablemill.operators import lineage, membership, mining, profile, sqlsteps


def test_statements_split_outside_quotes():
    script = "SELECT ';' AS a; -- x; y\n/* ; */ SELECT 1 - 2 / 3;;\n SELECT 'it''s;'"
    assert sqlsteps.split_statements(script) == ["SELECT ';' AS a", "SELECT 1 - 2 / 3", "SELECT 'it''s;'"]


def test_sql_over_restores_a_view_of_that_name(spark, frame):
    frame([("mine",)], "s string").createOrReplaceTempView("input")
    got = sqlsteps.sql_over(frame([(1,), (2,)], "a int"), "WITH x AS (SELECT a FROM input) SELECT a * :k AS b FROM x;", params={"k": 10})
    assert bag(got) == [(10,), (20,)]
    assert spark.table("input").head()[0] == "mine"
    spark.catalog.dropTempView("input")
    with pytest.raises(ValueError):
        sqlsteps.sql_over(frame([(1,)], "a int"), " ; ")
    assert sqlsteps.sql_over(frame([(1,)], "a int"), "", strict=False).count() == 1


def test_staging(spark, frame, database):
    df = frame([(1,)], "a int")
    names = sqlsteps.stage_tables({"1 odd-name": df, "b": df}, schema="s", table_mapping={"b": "bee"}, table_prefix="p_")
    assert names == {"1 odd-name": "s_p_1_odd_name", "b": "s_bee"}
    sqlsteps.stage_tables({"b": df}, schema="s", table_mapping={"b": "bee"}, if_exists="append")
    assert spark.table("s_bee").count() == 2
    with pytest.raises(ValueError):
        sqlsteps.stage_tables({"b": df}, schema="s", table_mapping={"b": "bee"}, if_exists="fail")
    for _ in range(2):
        sqlsteps.stage_tables({"t": df}, schema=database, as_table=True, if_exists="append")
    assert spark.table(f"{database}.t").count() == 2
    sqlsteps.stage_tables({"t": df}, schema=database, as_table=True)
    assert spark.table(f"{database}.t").count() == 1
    assert [tuple(r) for r in profile.catalog_stats(spark, database).collect()] == [("t", 1, 1)]
    assert table_identifier("9 a.b") == "t_9_a_b"


def test_steps_run_in_order(spark, frame, database):
    frame([(1,), (5,)], "a int").createOrReplaceTempView("t_steps")
    made = sqlsteps.run_steps(spark, [
        {"name": "one", "sql": "CREATE OR REPLACE TABLE t_one AS SELECT a + 1 AS b FROM t_steps", "tables_created": ["t_one"]},
        {"name": "two", "sql": "CREATE TABLE IF NOT EXISTS t_two AS SELECT sum(b) AS s FROM t_one", "depends_on": ["t_one"]}])
    assert made["t_two"].head()[0] == 8
    with pytest.raises(ValueError, match="needs"):
        sqlsteps.run_steps(spark, [{"name": "x", "sql": "SELECT 1", "depends_on": ["nowhere_x"]}])
    with pytest.raises(ValueError, match="did not create"):
        sqlsteps.run_steps(spark, [{"name": "x", "sql": "SELECT 1", "tables_created": ["zz"]}])
    stored = sqlsteps.run_script(spark, f"CREATE TABLE {database}.kept AS SELECT a FROM t_steps WHERE a > :n", params={"n": 1}, as_table=True)
    assert stored[f"{database}.kept"].count() == 1 and spark.catalog.tableExists(f"{database}.kept")


def test_transform_results_are_checked(frame):
    df = frame([(1,)], "a int")
    assert set(sqlsteps.run_transform(lambda x: {"y": x}, {"x": df})) == {"y"}
    with pytest.raises(TypeError):
        sqlsteps.run_transform(lambda x: {"y": 1}, {"x": df})


def test_cap(spark):
    spark.range(50).createOrReplaceTempView("t_fifty")
    assert sqlsteps.capped(spark, "SELECT * FROM t_fifty;", 10).count() == 10
    assert sqlsteps.capped(spark, "SELECT * FROM t_fifty LIMIT 20", 10).count() == 20


def test_lineage_with_a_cycle(frame):
    records = frame([("c", "x", "rename", [("b", "y")]), ("b", "y", "compute", [("a", "z"), ("a", "w")]), ("a", "z", None, [("c", "x")])],
                    "dataset string, column string, transformation string, upstream array<struct<dataset:string,column:string>>")
    edges = lineage.edges(records)
    assert ("c.x", "a.z", "unknown") in bag(edges)
    up = {(r.node, r.ancestor): r.depth for r in lineage.upstream(edges, edges.selectExpr('target as node')).collect()}
    assert up[("c.x", "a.w")] == 2 and up[("c.x", "c.x")] == 3 and len(up) == 3 * 4
    assert lineage.upstream(edges, edges.selectExpr('target as node'), max_depth=1).count() == 4
    only = lineage.upstream(edges, starts=frame([("b.y",)], "node string"))
    assert {r.node for r in only.collect()} == {"b.y"}
    assert bag(lineage.downstream(edges, frame([("a.w",)], "node string"))) == [("a.w", "b.y")]
    assert {r.id for r in lineage.nodes(records).where("type = 'dataset'").collect()} == {"a", "b", "c"}


def test_sql_text_facts(frame):
    df = frame([(1, "select a from s.t1 join T2 on 1=1 where x in (select 1 from s.t1)"), (2, "create table if not exists z.q as select 1"),
                (3, ""), (4, "((select 1)"), (5, r"select 'a\'b'"), (6, "select 'x"), (7, "nothing here"), (8, None), (9, "\n\t ")], "k int, q string")
    assert bag(mining.tables_referenced(df, "q", "k")) == [(1, "T2"), (1, "s.t1")]
    assert bag(mining.tables_created(df, "q", "k")) == [(2, "z.q")]
    assert {r.k: r.problem for r in mining.lint(df, "q").collect()} == {
        1: None, 2: None, 3: "empty", 4: "unbalanced parentheses", 5: None, 6: "unterminated string", 7: "no keyword", 8: "empty", 9: "empty"}
    bare = mining.strip_comments(frame([("a /* x\ny */ b -- c\nd",)], "q string"), "q", "b").head()["b"]
    assert bare == "a  b \nd"


def test_log_lines(frame):
    df = frame([(' {"level": "warn", "message": "m", "timestamp": "t", "metadata": {"a": 1}} ',), ('{"level": "info"}',), ("{broken",), ("  ",), (None,)], "line string")
    got = {(r.type, r.message, r.timestamp, r.metadata) for r in mining.parse_logs(df, "line").collect()}
    assert got == {("warning", "m", "t", '{"a":1}'), ("info", '{"level": "info"}', None, None), ("info", "{broken", None, None)}


def test_model_lines(frame):
    df = frame([("03:00 1 of 2 OK created sql table model land.part_a ...... [OK] in 0.07s",), ("2 of 2 ERROR creating sql view model b",), ("1 of 2 ERROR create sql view model b",)], "l string")
    assert {(r.model_name, r.full_path, r.status, r.model_type, r.object_type, r.seconds) for r in mining.model_runs(df, "l").collect()} == {
        ("part_a", "land.part_a", "ok", "sql", "table", 0.07), ("b", "b", "error", "sql", "view", 0.0)}


def test_snake_case(frame):
    df = frame([("customerOrderID",), ("HTTPServer-2 x",)], "s string")
    assert {r[0] for r in df.select(snake_case(F.col("s"))).collect()} == {"customer_order_id", "http_server_2_x"}


def test_profiles(frame):
    df = frame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {(r.column_name, r.data_type, r.nulls, r.rows, r.has_nulls) for r in profile.column_nulls(df).collect()} == {
        ("a", "int", 1, 3, True), ("b", "string", 2, 3, True)}
    assert bag(profile.table_stats({"x": df, "y": df.where("a = 1")})) == [("x", 3, 2), ("y", 1, 2)]


def test_scripts_with_schemas_hints_and_quoted_semicolons(spark, database):
    script = f"""CREATE TABLE {database}.clean AS SELECT /*+ REPARTITION(2) */ id, ';' AS "x" FROM range(5); -- note; here
    CREATE TABLE IF NOT EXISTS {database}.clean AS SELECT 1 AS id; CREATE TABLE {database}.total AS SELECT count(*) AS `n;m` FROM {database}.clean"""
    assert len(sqlsteps.split_statements(script)) == 3 and "/*+ REPARTITION(2) */" in sqlsteps.split_statements(script)[0]
    results = sqlsteps.run_script(spark, script.replace('"x"', "x"))
    assert results[f"{database}.total"].head()[0] == 5
    counts = {r.table: r.row_count for r in sqlsteps.created_counts(results).collect()}
    assert counts == {f"{database}.clean": 5, f"{database}.total": 1}
    made = sqlsteps.run_steps(spark, [{"name": "s", "sql": "CREATE TABLE kept AS SELECT 7 AS v", "schema": database, "tables_created": ["kept"]}])
    assert spark.table(f"{database}.kept").head()[0] == 7 and set(made) == {"kept"}


def test_a_stored_table_is_not_left_behind_a_view(spark, frame, database):
    spark.sql(f"USE {database}")
    try:
        spark.sql("CREATE TABLE input USING parquet AS SELECT 1 AS id")
        assert sqlsteps.sql_over(frame([(5,)], "id int"), "SELECT id FROM input").head()[0] == 5
        assert not spark.catalog.getTable("input").isTemporary and spark.table("input").head()[0] == 1
    finally:
        spark.sql("USE default")


def test_transform_outputs_are_written(spark, frame, database):
    df = frame([(1,), (2,)], "id int")
    for _ in range(2):
        made = sqlsteps.run_transform(lambda rows: {"kept": rows, "added": rows, "plain": rows}, {"rows": df}, outputs={"kept": "replace", "added": "append"}, schema=database)
    assert [made[n].count() for n in ("kept", "added", "plain")] == [2, 4, 2] and spark.table(f"{database}.added").count() == 4
    with pytest.raises(ValueError):
        sqlsteps.run_transform(lambda rows: {"a": rows}, {"rows": df}, outputs={"b": "append"})


def test_a_column_named_like_a_limit_does_not_lift_the_cap(spark):
    assert sqlsteps.capped(spark, "SELECT id AS credit_limit FROM range(20)", 5).count() == 5
    assert sqlsteps.capped(spark, "SELECT id FROM range(20) LIMIT 7", 5).count() == 7


def test_a_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    """A chain of 1,000 with a way back and a short cut: each doubling is one round."""
    edges = spark.range(1000).selectExpr("cast(id as string) as source", "cast(id + 1 as string) as target").unionByName(
        spark.createDataFrame([("1000", "900"), ("10", "500")], "source string, target string"))
    rounds = []
    doubled = lineage._doubled
    monkeypatch.setattr(lineage, "_doubled", lambda paths, jumps, *rest: rounds.append(paths is jumps) or doubled(paths, jumps, *rest))
    got = {r.ancestor: r.depth for r in lineage.upstream(edges, spark.createDataFrame([("600",)], "node string")).collect()}
    assert rounds.count(False) <= 11
    assert got["599"] == 1 and got["500"] == 100 and got["10"] == 101 and got["0"] == 111 and got["499"] == 101 and got["11"] == 589
    assert set(got) == {str(i) for i in range(600)}
    near = lineage.upstream(edges, spark.createDataFrame([("950",), ("x",)], "node string"), max_depth=60).collect()
    assert max(r.depth for r in near) == 60 and {r.ancestor for r in near} == {str(i) for i in [*range(890, 950), *range(991, 1001)]}


def sql_not_in(rows, listed):
    def might(a, b):
        return all(x is None or y is None or x == y for x, y in zip(a, b))

    return sorted((r for r in rows if not any(might(r[:-1], b) for b in listed)), key=repr)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_not_in_with_nulls(spark, width):
    rng = random.Random(width)
    schema = ", ".join(f"c{i} int" for i in range(width))

    def some(n, odds):
        return [tuple(None if rng.random() < odds else rng.randrange(4) for _ in range(width)) for _ in range(n)]

    rows = [(*r, i) for i, r in enumerate(some(60, 0.2))] + [(*[None] * width, 99)] * 2
    for listed in ([], some(6, 0.0), some(5, 0.25), some(3, 0.5), [tuple([None] * width)], some(40, 0.1)):
        df, others = spark.createDataFrame(rows, schema + ", id int"), spark.createDataFrame(listed, schema.replace("c", "o"))
        got = membership.not_in(df, others, [f"c{i}" for i in range(width)], [f"o{i}" for i in range(width)])
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect()), key=repr) == sql_not_in(rows, listed)


def test_not_in_needs_columns(frame):
    with pytest.raises(ValueError):
        membership.not_in(frame([(1,)], "a int"), frame([(1,)], "a int"), [])
