import datetime

import pytest
from conftest import bag
from pyspark.sql import functions as F

from tablemill.operators import mining
from tablemill.operators.quality import Expectation
from tablemill.streaming.batches import incremental_batches, merge_batches, quarantine_batches
from tablemill.streaming.keyed import first_of_each, with_repeats


def stream(spark, df, folder):
    """A source of one file per partition, one file per micro-batch."""
    df.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(source, handler, state):
    source.writeStream.foreachBatch(handler).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_merge_batches_and_replay(spark, database, tmp_path):
    name = f"{database}.t"
    rows = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("seq")).repartition(4)
    source = stream(spark, rows, str(tmp_path / "in"))
    run(source, merge_batches(name, ["k"], ["seq"]), str(tmp_path / "s1"))
    assert spark.table(name).count() == 10
    before = bag(spark.table(name).select("k"))
    run(source, merge_batches(name, ["k"], ["seq"]), str(tmp_path / "s2"))  # everything arrives again
    spark.catalog.refreshTable(name)  # a stream writes in a session of its own
    assert bag(spark.table(name).select("k")) == before


def test_incremental_batches_append_once(spark, database, tmp_path):
    name = f"{database}.t"
    source = stream(spark, spark.range(30).repartition(3), str(tmp_path / "in"))
    for state in ("s1", "s2"):
        run(source, incremental_batches(name), str(tmp_path / state))
    assert sorted(r.id for r in spark.table(name).collect()) == list(range(30))


def test_quarantine_batches(spark, database, tmp_path):
    name = f"{database}.t"
    source = stream(spark, spark.range(20).repartition(2), str(tmp_path / "in"))
    checks = [Expectation("small", "between", "id", {"max": 14}, "quarantine")]
    run(source, quarantine_batches(checks, incremental_batches(name), str(tmp_path / "bad")), str(tmp_path / "state"))
    assert spark.table(name).count() == 15 and spark.read.parquet(str(tmp_path / "bad")).count() == 5


def test_log_parsing_on_a_stream(spark, tmp_path):
    lines = spark.createDataFrame([('{"level": "ERROR", "message": "m"}',), ("plain",)], "line string")
    parsed = mining.parse_logs(stream(spark, lines, str(tmp_path / "in")), "line")
    parsed.writeStream.format("memory").queryName("t_logs").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert {(r.type, r.message) for r in spark.table("t_logs").collect()} == {("error", "m"), ("info", "plain")}


def test_stateless_operators_accept_streams(spark, tmp_path):
    from tablemill.operators import cleaning, headers
    from tablemill.operators.chain import apply_chain
    from tablemill.operators.quality import quarantine

    rows = spark.createDataFrame([(1, " A ", "5"), (2, "", "x"), (None, None, " ")], "`The Id` int, name string, v string")
    source = stream(spark, rows, str(tmp_path / "in"))
    chained = apply_chain(source, [
        "normalize_headers", "drop_empty_rows", {"name": "require_columns", "required": {"the_id": "id", "name": None, "v": "~"}},
        {"name": "type_cast", "type_cast": {"v": "int"}}, {"name": "add_constants", "add_constants": {"c": 1}},
        {"name": "filter", "rows": {"conditions": [{"type": "not", "conditions": [{"column": "id", "operator": ">", "value": 5}]}]},
         "columns": {"exclude": ["c"]}}])
    clean, caught = quarantine(cleaning.null_tokens(headers.dedupe_headers(chained), [""]), [
        Expectation("v", "not_null", "v", action="quarantine"), Expectation("n", "regex_match", "name", {"pattern": "A"}, "quarantine"),
        Expectation("i", "in_set", "id", {"values": [1, 2]}, "quarantine")])
    for name, df in (("t_clean", clean), ("t_caught", caught)):
        assert df.isStreaming
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert [tuple(r) for r in spark.table("t_clean").collect()] == [(1, " A ", 5)]
    assert [(r.id, r._quality_check) for r in spark.table("t_caught").collect()] == [(2, "v")]


TIMED = "id int, k string, j int, t timestamp, v double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes, microseconds=7)


def through(spark, tmp_path, batches, change):
    """Each batch is a run of its own, which starts from the checkpoint of the one before."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(TIMED).parquet(folder)
        change(source).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_a_key_that_comes_again_in_a_later_batch(spark, tmp_path):
    batches = [
        [(1, "a", 1, at(0), 1.5), (2, "b", 1, at(1), None), (3, None, 1, at(1), 2.0), (4, "n", None, at(1), 2.0), (5, "t", 1, None, 0.1)],
        [(6, "a", 1, at(5), float("nan")), (7, "c", 1, at(5), 1.0), (8, None, 1, at(5), 2.0), (9, "a", 2, at(5), 0.0)],
        [(10, "a", 1, at(6), 0.0), (11, "d", 1, at(6), 0.0), (12, "d", 1, at(6), 0.0), (13, "d", 1, at(7), 0.0)],
        [(99, "end", 0, at(10_000), 0.0)], [(100, "end", 1, at(20_000), 0.0)],
    ]
    got = through(spark, tmp_path, batches, lambda s: with_repeats(s, ["k", "j"], "t", "30 minutes")).where("id < 99").collect()
    assert {r.id: r.repeated for r in got} == {i: i in (1, 6, 10, 11, 12, 13) for i in range(1, 14)} and len(got) == 13
    first = next(r for r in got if r.id == 1)
    assert (first.k, first.j, first.t, first.v) == ("a", 1, at(0), 1.5)


def test_keys_are_forgotten_when_the_span_is_over(spark, tmp_path):
    batches = [[(1, "a", 1, at(0), 0.0)], [(2, "z", 1, at(200), 0.0)], [(3, "a", 1, at(201), 0.0)], [(4, "y", 1, at(900), 0.0)], [(5, "x", 1, at(1900), 0.0)]]
    got = through(spark, tmp_path, batches, lambda s: with_repeats(s, ["k"], "t", "1 hour")).collect()
    assert {r.id: r.repeated for r in got} == {1: False, 2: False, 3: False, 4: False}
    with pytest.raises(ValueError):
        with_repeats(spark.createDataFrame([], TIMED), ["k"], "t", "a while")


def test_first_of_each_key_over_batches(spark, tmp_path):
    batches = [[(1, "a", 1, at(0), 0.0), (2, "b", 1, at(0), 0.0)], [(3, "a", 1, at(1), 0.0), (4, None, 1, at(1), 0.0)], [(5, "b", 1, at(2), 0.0), (6, None, 1, at(2), 0.0)]]
    got = through(spark, tmp_path, batches, lambda s: first_of_each(s, ["k"], "t", "1 hour"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 4]


def test_only_new_files_are_taken(spark, tmp_path):
    from tablemill.streaming.incoming import take_new_files

    seen, folder = [], tmp_path / "in"

    def take(fail=False):
        def keep(batch, epoch):
            if fail:
                raise RuntimeError("cut off")
            seen.extend((r.a, r.f.rsplit("/", 1)[-1]) for r in batch.collect())

        return take_new_files(spark, str(folder), str(tmp_path / "state"), keep, schema="a long", pattern="*.json", recursive=True, file_column="f", files_per_batch=1)

    for name, text in (("one.json", '{"a": 1}'), ("deep/two.json", '{"a": 2}'), ("other.txt", "x")):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    assert take() == 2 and sorted(seen) == [(1, "one.json"), (2, "two.json")]
    assert take() == 0
    (folder / "deep/three.json").write_text('{"a": 3}')
    with pytest.raises(Exception, match="cut off"):
        take(fail=True)
    assert take() == 1 and seen[2:] == [(3, "three.json")]


def test_many_keys_share_states(spark, tmp_path):
    """6,000 keys, each in a state of its own before; every third comes again, in the same micro-batch or a later one."""
    from tablemill.streaming.keyed import BUCKETS

    rows = spark.range(6_000).selectExpr("cast(id as int) id", "cast(id as string) k", "1 j", "timestamp_seconds(1700000000 + id % 50) t", "cast(id as double) v")
    again = rows.where("id % 3 = 0").selectExpr("id + 10000 id", "k", "j", "t", "v")
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    ends = spark.createDataFrame([(-1, "end", 1, at(10_000_000), 0.0), (-2, "end", 2, at(20_000_000), 0.0)], TIMED)
    for part in (rows.union(again.where("id % 2 = 0")), again.where("id % 2 = 1"), ends.where("id = -1"), ends.where("id = -2")):
        part.coalesce(1).write.mode("append").parquet(folder)
        run = with_repeats(spark.readStream.schema(TIMED).parquet(folder), ["k", "j"], "t", "30 minutes").writeStream.format("parquet").option(
            "checkpointLocation", state).trigger(availableNow=True).start(out)
        run.awaitTermination()
        seen += [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    got = {r.id: r.repeated for r in spark.read.parquet(out).where("id >= 0").collect()}
    assert got == {i: i >= 10_000 or i % 3 == 0 for i in [*range(6_000), *range(10_000, 16_000, 3)] if i < 6_000 or (i - 10_000) % 3 == 0}
    assert 0 < max(seen) <= BUCKETS


def test_keys_of_one_state_keep_their_own_time(spark, tmp_path):
    batches = [
        [(1, "a", 1, at(0), 0.0), (2, "b", 1, at(50), -0.0)], [(3, "z", 1, at(100), 5.0)], [(4, "a", 1, at(101), 0.0), (5, "b", 1, at(101), 0.0)],
        [(6, "c", 1, at(900), float("nan"))], [(7, "c", 1, at(910), float("nan"))], [(8, "y", 1, at(2000), 0.0)], [(9, "x", 1, at(4000), 0.0)], [(10, "w", 1, at(6000), 0.0)],
    ]
    got = through(spark, tmp_path, batches, lambda s: with_repeats(s, ["k", "v"], "t", "40 minutes", buckets=1)).collect()
    marks = {r.id: r.repeated for r in got}
    assert len(got) == len(marks) and {i: marks[i] for i in (1, 3, 4, 8)} == {1: False, 3: False, 4: False, 8: False}
    assert marks[2] and marks[5] and marks[6] and marks[7]
