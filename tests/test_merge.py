import pytest
from conftest import bag
from pyspark.sql import functions as F

from tablemill.operators import merge
from tablemill.sinks.tables import write_idempotent, write_table


@pytest.fixture
def target(frame):
    return frame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0), (None, "n", 0.0)], "id int, s string, v double")


@pytest.fixture
def batch(frame):
    return frame([(2, "B", 1), (2, "BB", 2), (9, None, 1), (None, "m", 1)], "id int, s string, seq int")


def test_update_keeps_columns_the_batch_lacks(target, batch):
    got = merge.merge(target, batch, ["id"], "update", ["seq"])
    assert bag(got) == sorted([(1, "a", 1.0), (2, "BB", 2.0), (3, "c", 3.0), (None, "m", 0.0), (9, None, None)], key=repr)


def test_update_writes_nulls(frame, target):
    got = merge.merge(target, frame([(1, None)], "id int, s string"), ["id"])
    assert (1, None, 1.0) in bag(got)


def test_ignore_and_delete_insert(target, batch):
    assert bag(merge.merge(target, batch, ["id"], "ignore", ["seq"])) == sorted(
        bag(target) + [(9, None, None)], key=repr)
    assert bag(merge.merge(target, batch, ["id"], "delete_insert", ["seq"])) == sorted(
        [(1, "a", 1.0), (3, "c", 3.0), (2, "BB", None), (9, None, None), (None, "m", None)], key=repr)


def test_repeated_key_is_an_error_without_an_order(target, batch):
    with pytest.raises(ValueError, match="repeats a key"):
        merge.merge(target, batch, ["id"])
    with pytest.raises(ValueError):
        merge.merge(target, batch, [])
    with pytest.raises(ValueError):
        merge.merge(target, batch, ["id"], "replace", ["seq"])


def test_target_key_that_repeats(frame, batch):
    hot = frame([(2, "x")] * 5 + [(7, "y")], "id int, s string")
    assert bag(merge.merge(hot, batch.where("id = 2"), ["id"], "update", ["seq"])) == [(2, "BB")] * 5 + [(7, "y")]
    assert tuple(merge.merge_stats(hot, batch.where("id = 2"), ["id"], "update", ["seq"]).head()) == (0, 5, 0)


def test_stats_are_exact(target, batch):
    stats = lambda s: tuple(merge.merge_stats(target, batch, ["id"], s, ["seq"]).head())
    assert stats("update") == (1, 2, 0)
    assert stats("ignore") == (1, 0, 0)
    assert stats("delete_insert") == (3, 0, 2)


def test_dedupe_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    got = merge.dedupe_last(df, ["k"], ["id"])
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert bag(got) == [(0, 99), (1, 97), (2, 98)]


def test_hash_of_null_rows(frame):
    rows = frame([(1, None), (1, "\\N"), (2, "x")], "a int, b string")
    hashes = [r._row_hash for r in merge.with_row_hash(rows).collect()]
    assert None not in hashes and hashes[2] not in hashes[:2]
    grown = merge.incremental(rows.limit(2), rows)
    assert grown.where("a = 2").count() == 1 and grown.count() == 3


def test_one_hash_formula_for_old_and_new_rows(frame, database, spark):
    name = f"{database}.t"
    frame([(1, None), (2, "x")], "a int, b string").write.saveAsTable(name)  # a table without the hash column
    stats = write_idempotent(frame([(1, None), (3, "y")], "a int, b string"), name, "incremental")
    assert stats["rows_inserted"] == 1
    assert sorted(r.a for r in spark.table(name).collect()) == [1, 2, 3]
    again = write_idempotent(frame([(1, None), (3, "y")], "a int, b string"), name, "incremental")
    assert again["rows_inserted"] == 0


def test_append_overwrite_and_missing_table(frame, database, spark):
    name = f"{database}.t"
    rows = frame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="does not exist"):
        write_idempotent(rows, name, create_if_missing=False)
    assert write_idempotent(rows, name)["rows_inserted"] == 1
    write_idempotent(frame([("y", 2)], "b string, a int"), name)  # columns match by name
    assert bag(spark.table(name)) == [(1, "x"), (2, "y")]
    write_idempotent(frame([(5, "z"), (5, "zz")], "a int, b string"), name, "overwrite", keys=["a"], order_by=["b"])
    assert bag(spark.table(name)) == [(5, "zz")]
    with pytest.raises(ValueError):
        write_idempotent(rows, name, "upsert?")


def test_merge_into_table_twice(frame, database, spark, target, batch):
    name = f"{database}.t"
    write_idempotent(target, name)
    first = write_idempotent(batch, name, "merge", keys=["id"], order_by=["seq"])
    assert (first["rows_inserted"], first["rows_updated"]) == (1, 2)
    with pytest.raises(ValueError, match="repeats"):
        write_idempotent(batch, name, "merge", keys=["id"])
    rows = bag(spark.table(name))
    write_idempotent(batch, name, "merge", keys=["id"], order_by=["seq"])
    assert bag(spark.table(name)) == rows
    assert [t.name for t in spark.catalog.listTables(database)] == ["t"]


def test_a_replaced_table_keeps_its_place_in_the_catalog(frame, database, spark, tmp_path):
    name = f"{database}.t"
    rows = frame([(1, "x")], "a int, b string")
    rows.write.option("path", str(tmp_path / "outside")).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('team' = 'me')")
    spark.sql(f"ALTER TABLE {name} ALTER COLUMN b COMMENT 'about b'")
    write_idempotent(frame([(1, "X"), (2, "y")], "a int, b string"), name, "merge", keys=["a"])
    write_table(spark.table(name), name, "replace")
    told = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert told["Type"] == "EXTERNAL" and "team=me" in told["Table Properties"]
    assert [c.description for c in spark.catalog.listColumns(name)] == [None, "about b"]
    assert bag(spark.table(name)) == [(1, "X"), (2, "y")]


def test_null_keys_and_replays(frame, database, spark):
    name = f"{database}.t"
    write_idempotent(frame([(1, "x"), (None, "old")], "a int, b string"), name)
    batch = frame([(None, "new"), (2, "y")], "a int, b string")
    for _ in range(2):
        write_idempotent(batch, name, "merge", keys=["a"])
        assert sorted(bag(spark.table(name)), key=repr) == sorted([(1, "x"), (2, "y"), (None, "new")], key=repr)


def test_overwrite_from_itself_and_unknown_columns(frame, database, spark):
    name = f"{database}.t"
    write_idempotent(frame([(1, "x"), (2, "y")], "a int, b string"), name)
    assert write_idempotent(spark.table(name).where("a = 2"), name, "overwrite")["rows_inserted"] == 1
    assert bag(spark.table(name)) == [(2, "y")]
    for mode in ("append", "overwrite", "merge"):
        with pytest.raises(ValueError, match="no columns"):
            write_idempotent(frame([(1, "x", 3)], "a int, b string, c int"), name, mode, keys=["a"])


def test_merge_touches_more_partitions_than_could_be_listed(database, spark):
    name = f"{database}.t"
    rows = spark.range(0, 300).selectExpr("id as a", "'old' as b", "if(id = 7, null, id) as p")
    write_idempotent(rows, name, partition_by=["p"])
    batch = spark.range(0, 200).selectExpr("id as a", "'new' as b", "if(id = 7, null, id) as p")
    stats = write_idempotent(batch, name, "merge", keys=["a", "p"], partition_by=["p"])
    assert (stats["rows_inserted"], stats["rows_updated"]) == (0, 200)
    assert spark.table(name).where("b = 'new'").count() == 200 and spark.table(name).count() == 300


def test_partitioned_merge_leaves_other_partitions_alone(frame, database, spark):
    import glob
    import os

    name = f"{database}.t"
    rows = frame([(1, "x", 1), (2, "y", 1), (3, "z", 2)], "a int, b string, p int")
    write_idempotent(rows, name, partition_by=["p"])
    folder = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").head()["data_type"].replace("file:", "")
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/p=2/*.parquet")}
    stats = write_idempotent(frame([(1, "X", 1), (4, "new", 3)], "a int, b string, p int"), name, "merge", keys=["a", "p"], partition_by=["p"])
    assert (stats["rows_inserted"], stats["rows_updated"]) == (1, 1)
    assert bag(spark.table(name)) == [(1, "X", 1), (2, "y", 1), (3, "z", 2), (4, "new", 3)]
    assert files and {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/p=2/*.parquet")} == files


def test_partition_column_outside_the_keys(frame, database, spark):
    """A key may move to another partition, so the whole table is rewritten; it stays partitioned."""
    name = f"{database}.t"
    write_idempotent(frame([(1, "x", 1), (2, "y", 2)], "a int, b string, p int"), name, partition_by=["p"])
    stats = write_idempotent(frame([(1, "X", 2), (3, "z", 3)], "a int, b string, p int"), name, "merge", keys=["a"], partition_by=["p"])
    assert (stats["rows_inserted"], stats["rows_updated"]) == (1, 1)
    assert bag(spark.table(name)) == [(1, "X", 2), (2, "y", 2), (3, "z", 3)]
    assert spark.sql(f"SHOW PARTITIONS {name}").count() == 2


def test_hash_column_is_added_to_a_partitioned_table(frame, database, spark):
    name = f"{database}.t"
    frame([(1, 1), (2, 2)], "a int, p int").write.partitionBy("p").saveAsTable(name)
    batch = frame([(2, 2), (1, 3)], "p int, a int")
    assert write_idempotent(batch, name, "incremental")["rows_inserted"] == 1
    assert bag(spark.table(name).select("a", "p")) == [(1, 1), (2, 2), (3, 1)]
    assert spark.table(name).where("_row_hash is null").count() == 0 and spark.sql(f"SHOW PARTITIONS {name}").count() == 2
    assert write_idempotent(batch, name, "incremental")["rows_inserted"] == 0


def test_write_table_modes(frame, database, spark):
    name = f"{database}.t"
    write_table(frame([(1, "x", 2.5)], "a int, b string, c double"), name, "fail")
    write_table(frame([("q", 9, 1)], "b string, z int, a int"), name, "append")
    assert bag(spark.table(name)) == sorted([(1, "x", 2.5), (1, "q", None)], key=repr)
    with pytest.raises(ValueError, match="no column in common"):
        write_table(frame([(1,)], "zz int"), name, "append")
    with pytest.raises(Exception, match="already exists"):
        write_table(frame([(1,)], "a int"), name, "fail")
    write_table(frame([(5,)], "a int"), name, "append", all_varchar=True)
    assert {t for _, t in spark.table(name).dtypes} == {"string"} and spark.table(name).count() == 3
    write_table(spark.table(name).where("a = 5"), name, "replace")  # may read the table it replaces
    assert bag(spark.table(name)) == [("5", None, None)]


def test_row_hashes_tell_cells_apart(frame):
    from tablemill.functions.rowhash import row_hash

    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("\\N", "x"), ("-", "x"), ("1:a", ""), ("1", ":a"), (None, None)]
    df = frame(rows, "p string, q string")
    assert df.select(row_hash(["p", "q"]).alias("h")).distinct().count() == len(rows)


def files_of(spark, name):
    import os

    return {f: os.path.getmtime(f.replace("file://", "")) for f in spark.table(name).inputFiles()}


def test_a_merge_leaves_files_without_its_keys_alone(frame, database, spark):
    name = f"{database}.t"
    rows = spark.range(1000).selectExpr("cast(id as int) as a", "concat('v', id) as b")
    write_idempotent(rows.repartitionByRange(10, "a"), name)
    before = files_of(spark, name)
    assert len(before) == 10
    for _ in range(2):  # a replay changes nothing
        stats = write_idempotent(frame([(7, "new"), (2000, "more")], "a int, b string"), name, "merge", keys=["a"])
        assert len(before.items() - files_of(spark, name).items()) == 1
        expected = {i: f"v{i}" for i in range(1000)} | {7: "new", 2000: "more"}
        assert {r.a: r.b for r in spark.table(name).collect()} == expected and spark.table(name).count() == 1001
    assert stats == {"mode": "merge", "rows_inserted": 0, "rows_updated": 2, "rows_deleted": 0}
    held = files_of(spark, name)
    write_idempotent(frame([(8, "x"), (3000, "y")], "a int, b string"), name, "merge", keys=["a"], strategy="ignore")
    assert held.items() <= files_of(spark, name).items() and spark.table(name).where("b = 'v8'").count() == 1
    stats = write_idempotent(frame([(8, "x"), (8000, "y")], "a int, b string"), name, "merge", keys=["a"], strategy="delete_insert")
    assert (stats["rows_inserted"], stats["rows_deleted"]) == (2, 1) and spark.table(name).count() == 1003


def test_a_merge_that_was_cut_off_is_finished(frame, database, spark, monkeypatch):
    from tablemill.sinks import tables

    name = f"{database}.t"
    write_idempotent(frame([(1, "x"), (2, "y")], "a int, b string").repartitionByRange(2, "a"), name)
    finish = tables._finish_merges
    calls = []

    def stop(session, folder):
        calls.append(folder)
        if len(calls) == 2:
            raise RuntimeError("cut off")
        return finish(session, folder)

    monkeypatch.setattr(tables, "_finish_merges", stop)
    with pytest.raises(RuntimeError):
        write_idempotent(frame([(1, "X")], "a int, b string"), name, "merge", keys=["a"])
    assert bag(spark.table(name)) == [(1, "x"), (2, "y")]
    write_idempotent(frame([(3, "z")], "a int, b string"), name, "merge", keys=["a"])
    assert bag(spark.table(name)) == [(1, "X"), (2, "y"), (3, "z")]


def test_files_of_a_replaced_table_outlive_one_replacement(frame, database, spark, tmp_path):
    name, folder = f"{database}.t", tmp_path / "outside"
    frame([(1,)], "a int").write.option("path", str(folder)).saveAsTable(name)
    (folder / "_notes.md").write_text("mine")
    first = spark.table(name)
    first.inputFiles()
    write_table(frame([(2,)], "a int"), name, "replace")
    assert bag(spark.read.parquet(str(folder))) == [(1,)] and bag(spark.table(name)) == [(2,)]
    write_table(frame([(3,)], "a int"), name, "replace")
    assert not list(folder.glob("*.parquet")) and (folder / "_notes.md").read_text() == "mine" and bag(spark.table(name)) == [(3,)]


def test_partition_values_with_odd_signs(frame, database, spark):
    name = f"{database}.t"
    write_idempotent(frame([(1, "x", "a b"), (2, "y", "c%d/e"), (3, "z", "k")], "a int, b string, p string"), name, partition_by=["p"])
    write_idempotent(frame([(1, "X", "c%d/e"), (2, "Y", "c%d/e"), (4, "n", "ü ü")], "a int, b string, p string"), name, "merge", keys=["a"])
    assert bag(spark.table(name)) == [(1, "X", "c%d/e"), (2, "Y", "c%d/e"), (3, "z", "k"), (4, "n", "ü ü")]


def test_incremental_batches_read_their_buckets_only(database, spark, frame):
    from tablemill.sinks import hashindex

    name = f"{database}.t"
    rows = spark.range(3000).selectExpr("id", "concat('v', id) as b")
    write_idempotent(rows.where("id < 2000"), name, "incremental")
    assert write_idempotent(rows.where("id between 1000 and 2499"), name, "incremental")["rows_inserted"] == 500
    small = rows.where("id in (7, 2800)")
    hashed = merge.with_row_hash(small)
    plan = hashindex.unseen(name, hashed, "_row_hash")._jdf.queryExecution().executedPlan().toString()
    hit = hashindex._placed(hashed.where("id = 7"), "_row_hash", hashindex.BUCKETS).head()["__bucket"]
    assert "bucket#" in plan and f"IN ({hit})" in plan.replace(f"= {hit})", f"IN ({hit}))").replace("INSET", "IN")
    assert write_idempotent(small, name, "incremental")["rows_inserted"] == 1
    assert spark.table(name).count() == 2501 and spark.table(hashindex.hash_table(name)).count() == 2501
    write_idempotent(frame([(9000, "x")], "id long, b string"), name, "append")  # behind the index's back, without a hash
    assert write_idempotent(rows, name, "incremental")["rows_inserted"] == 499
    assert write_idempotent(rows, name, "incremental", hash_buckets=3)["rows_inserted"] == 0


def test_an_append_that_was_not_remembered_is_not_repeated(database, spark, monkeypatch):
    from tablemill.sinks import hashindex

    name, rows = f"{database}.t", spark.range(50)
    write_idempotent(rows.where("id < 20"), name, "incremental")

    def fail(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(hashindex, "remember", fail)
        with pytest.raises(RuntimeError):
            write_idempotent(rows, name, "incremental")
    assert write_idempotent(rows, name, "incremental")["rows_inserted"] == 0 and spark.table(name).count() == 50
