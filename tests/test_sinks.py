import datetime
import json

import pytest
import yaml
from conftest import bag
from pyspark.sql import functions as F

from tablemill.sinks import documents, files


@pytest.fixture
def df(frame):
    return frame([(1, "ä \"q\" <b>", datetime.date(2024, 1, 2)), (2, None, None), (3, "😀", datetime.date(2024, 3, 4))], "id int, s string, d date")


def text_of(path):
    import glob

    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/**/part-*", recursive=True)))


def test_jsonl_keeps_nulls(df, tmp_path):
    files.write_jsonl(df, str(tmp_path / "j"))
    rows = [json.loads(line) for line in text_of(tmp_path / "j").splitlines()]
    assert {"id": 2, "s": None, "d": None} in rows and {"id": 1, "s": "ä \"q\" <b>", "d": "2024-01-02"} in rows


def test_jsonl_ascii(df, tmp_path):
    files.write_jsonl(df, str(tmp_path / "j"), ensure_ascii=True)
    text = text_of(tmp_path / "j")
    assert text.isascii() and "\\ud83d\\ude00" in text and "\\u00e4" in text
    assert {json.loads(line)["s"] for line in text.splitlines()} == {"ä \"q\" <b>", None, "😀"}


@pytest.mark.parametrize("orient", ["records", "columns"])
def test_json_documents_hold_every_row_in_order(spark, orient):
    df = spark.range(95).select((94 - F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("s")).repartition(4)
    docs = documents.json_documents(df, ["id"], orient, rows_per_document=20, ranges=5).orderBy("doc_no").collect()
    parsed = [json.loads(r.json) for r in docs]
    assert [r.doc_no for r in docs] == [0, 1, 2, 3, 4]
    ids = [i for d in parsed for i in (d["id"] if orient == "columns" else [r["id"] for r in d])]
    assert ids == list(range(95))
    texts = [i for d in parsed for i in (d["s"] if orient == "columns" else [r["s"] for r in d])]
    assert texts.count(None) == 47


def test_documents_are_whole_files(spark, tmp_path):
    docs = documents.json_documents(spark.range(10), ["id"], rows_per_document=5)
    documents.write_documents(docs, str(tmp_path / "d"), "json")
    assert json.loads(text_of(tmp_path / "d" / "doc_no=1")) == [{"id": i} for i in range(5, 10)]


def test_yaml(df, tmp_path):
    documents.write_yaml(df, str(tmp_path / "y"))
    rows = yaml.safe_load(text_of(tmp_path / "y"))
    assert sorted(rows, key=lambda r: r["id"])[0] == {"id": 1, "s": "ä \"q\" <b>", "d": datetime.date(2024, 1, 2)}
    wrapped = documents.yaml_documents(documents.json_documents(df, ["id"]), wrap="rows").head()["yaml"]
    assert [r["id"] for r in yaml.safe_load(wrapped)["rows"]] == [1, 2, 3]
    keys = documents.yaml_rows(df.limit(1), sort_keys=True).head()["yaml"].replace("- ", "  ").split("\n")
    assert [k.strip().split(":")[0] for k in keys] == ["d", "id", "s"]


def test_yaml_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    """One partition of 25,000 rows was one list, which a reader parses in one piece."""
    documents.write_yaml(spark.range(25_000).coalesce(1), str(tmp_path / "y"))
    files_of = [yaml.load(p.read_text(), Loader=yaml.CSafeLoader) for p in (tmp_path / "y").glob("part-*")]
    assert sorted(map(len, files_of)) == [5_000, 10_000, 10_000]
    assert sorted(r["id"] for rows in files_of for r in rows) == list(range(25_000))


def test_xml_nulls(df, tmp_path):
    files.write_xml(df.orderBy("id").coalesce(1), str(tmp_path / "e"), root="r", row="x")
    assert "<s/>" in text_of(tmp_path / "e").replace("<s></s>", "<s/>")
    files.write_xml(df.orderBy("id").coalesce(1), str(tmp_path / "a"), root="r", row="x", as_attr=True)
    text = text_of(tmp_path / "a")
    assert 'id="2"' in text and text.count(" s=") == 2


def test_html_escapes(df):
    row = files.html_rows(df.where("id = 1")).head()["html"]
    assert row == "<tr><td>1</td><td>ä &quot;q&quot; &lt;b&gt;</td><td>2024-01-02</td></tr>"
    assert files.html_rows(df.where("id = 2").withColumn("n", F.lit(0)), index="n").head()["html"] == "<tr><td>0</td><td>2</td><td></td><td></td></tr>"
    assert files.html_header(["a<b"], include_index=True) == "<tr><th>index</th><th>a&lt;b</th></tr>"


def test_nested_parts_hold_every_child(spark):
    """One parent has most children; no list is longer than the limit."""
    parents = spark.range(4).select(F.col("id").alias("k"), F.concat(F.lit("p"), "id").alias("name"))
    children = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 2 + 1).alias("k"), F.col("id").alias("c"))
    nested = documents.nest(parents, children, ["k"], ["c"], "kids", max_children=40, ranges=5)
    rows = nested.orderBy("k", "part").collect()
    assert [(r.k, r.part, len(r.kids)) for r in rows] == [(0, 0, 40), (0, 1, 40), (0, 2, 40), (0, 3, 30), (1, 0, 25), (2, 0, 25), (3, 0, 0)]
    assert sorted(k.c for r in rows for k in r.kids) == list(range(200))
    xml = documents.xml_documents(nested.where("k = 1"), "parent", [], attributes=["k"]).head()["xml"]
    assert xml.startswith('<parent k="1">') and xml.count("<kids>") == 25


def test_csv_options_and_split(df, tmp_path):
    files.write_csv(df, str(tmp_path / "c"), include_header=False, delimiter="|")
    assert "id" not in text_of(tmp_path / "c") and '1|"ä ""q"" <b>"|2024-01-02' in text_of(tmp_path / "c")
    files.write_split(df, str(tmp_path / "s"), "d", "parquet")
    assert (tmp_path / "s" / "d=2024-01-02").is_dir()


def test_export_gets_its_parameters(df):
    assert files.run_export(lambda d, p: (d.count(), p["x"]), df, {"x": 5}) == (3, 5)


def test_partitioned_writes_are_rebalanced(spark, tmp_path):
    """One file per value where values are small, although every task holds every value."""
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("p")).repartition(8)
    assert "RebalancePartitions" in files.spread(df, ["p"])._jdf.queryExecution().optimizedPlan().toString()
    files.write_parquet(df, str(tmp_path / "p"), partition_by=["p"])
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "p").glob("p=*"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1000
