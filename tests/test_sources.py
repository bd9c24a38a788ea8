import gzip

import pytest
from conftest import bag
from pyspark.sql import functions as F

from tablemill.plans.fixtures import workbook_bytes
from tablemill.sources import delimited, documents, files, markup, tables, workbooks


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(folder)


def test_patterns_and_discovery(spark, tmp_path):
    assert files.split_patterns("﻿'a.csv' ; b.csv,\r\n\"c.csv\"\n") == ["a.csv", "b.csv", "c.csv"]
    assert files.split_patterns(["x;y", " "]) == ["x;y"]
    base = put(tmp_path, "Data One.CSV", "a\n1\n")
    put(tmp_path, "sub/deep.csv", "a\n2\n")
    assert len(files.source_paths(spark, base, "data one.csv")) == 1
    assert files.source_paths(spark, base, "*.txt") == []
    with pytest.raises(FileNotFoundError):  # a named file that is not there, even beside one that is
        files.source_paths(spark, base, "data one.csv; missing.csv")
    assert [p.rsplit("/", 1)[-1] for p in files.source_paths(spark, base, "*.csv", recursive=True)] == ["deep.csv"]
    assert files.source_paths(spark, "/elsewhere", f"{base}/sub/deep.csv") == [f"{base}/sub/deep.csv"]
    assert files.source_paths(spark, f"{base}/sub/deep.csv") == [f"{base}/sub/deep.csv"]
    with pytest.raises(FileNotFoundError):
        delimited.read_csv(spark, base, "nothing.csv")


def test_csv_types_tokens_and_ragged_lines(spark, tmp_path):
    base = put(tmp_path, "a.csv", 'id;name;name.;score;day;flag\n1;"x;y";NA;1.5;2024-01-02;true\n2;;q;NaN;;false;surplus\n3;z\n')
    df = delimited.read_csv(spark, base)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("name._1", "string"), ("score", "double"), ("day", "date"), ("flag", "boolean")]
    rows = bag(df.select("id", "name", F.col("`name._1`"), "score", "flag"))
    assert rows == sorted([(1, "x;y", None, 1.5, True), (2, None, "q", None, False), (3, "z", None, None, None)], key=repr)


def test_csv_late_surprises_are_kept(spark, tmp_path):
    base = put(tmp_path, "a.csv", "n\n" + "1\n" * 2500 + "oops\n")
    assert delimited.read_csv(spark, base).where("n = 'oops'").count() == 1  # all rows decide on the type
    assert delimited.read_csv(spark, base, infer=False).where("n = 'oops'").count() == 1
    assert delimited.read_csv(spark, base, schema={"n": "string"}).count() == 2501


def test_csv_skip_rows_in_every_file(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"f{i}.csv", f"report, {i}\n\nk|v\n{i}|a{i}\n{i}0|b{i}\n")
    got = delimited.read_csv(spark, str(tmp_path), skip_rows=2)
    assert bag(got) == sorted([(i, f"a{i}") for i in range(3)] + [(i * 10, f"b{i}") for i in range(3)], key=repr)
    put(tmp_path, "x/plain.csv", "1,a\n2,b\n")
    assert delimited.read_csv(spark, str(tmp_path / "x"), has_header=False).columns == ["column_1", "column_2"]


@pytest.mark.parametrize("text,expected", [("a;b;c\n1;2;3", ";"), ("a\tb\n1\t2", "\t"), ("plain", ","), ("a|b|c\n1|2|3", "|"), ("", ",")])
def test_separator(text, expected):
    assert delimited.sniff_separator(text.splitlines()) == expected


def test_json_shapes(spark, tmp_path):
    base = put(tmp_path, "a.json", '{"d": {"items": [{"a": 1}, {"a": 2, "b": "x"}], "nums": [1, 2], "one": {"k": true}, "s": "t", "none": null}}')
    read = lambda path=None: documents.read_json(spark, base, json_path=path)
    assert bag(read("d.items")) == sorted([(1, None), (2, "x")], key=repr)
    assert bag(read("d.nums")) == [(1,), (2,)] and read("d.nums").columns == ["value"]
    assert bag(read("d.one")) == [(True,)]
    assert bag(read("d.s")) == [("t",)]
    assert read("d.absent.more").count() == 0 and read("d.none").count() == 0
    assert read().columns == ["d"]
    put(tmp_path, "l/list.json", '[{"a": 1}, {"a": 2}]')
    assert bag(documents.read_json(spark, str(tmp_path / "l"))) == [(1,), (2,)]


def test_jsonl_leaves_out_noise(spark, tmp_path):
    base = put(tmp_path, "a.jsonl.gz", '# note\n\n{"a": 1, "b": "x"}\n{"a": \n  {"a": 2}\n"text"\n')
    assert bag(documents.read_jsonl(spark, base, "*.gz")) == sorted([(1, "x"), (2, None)], key=repr)
    assert documents.read_jsonl(spark, base, "*.gz", columns=["b", "zz"]).columns == ["b"]
    assert documents.read_jsonl(spark, base, "*.gz", scalars=True).count() == 3
    put(tmp_path, "s/only.jsonl", '1\n"two"\n[3]\n')
    assert bag(documents.read_jsonl(spark, str(tmp_path / "s"))) == [('"two"',), ("1",), ("[3]",)]
    put(tmp_path, "v/v.jsonl", '{"value": 7}\n')
    assert bag(documents.read_jsonl(spark, str(tmp_path / "v"))) == [(7,)]


def test_yaml(spark, tmp_path):
    base = put(tmp_path, "a.yaml", "top:\n  rows:\n  - {id: 1, when: 2024-01-02}\n  - {id: 2, tags: [a, b]}\n")
    put(tmp_path, "b.yml", "top:\n  rows:\n  - {id: 3}\n")
    got = documents.read_yaml(spark, base, json_path="top.rows")
    assert bag(got.select("id", "when", "tags")) == sorted([(1, "2024-01-02", None), (2, None, ["a", "b"]), (3, None, None)], key=repr)
    assert documents.read_yaml(spark, base, json_path="top.rows", schema="array<struct<id:int>>").dtypes == [("id", "int")]


XML = """<?xml version="1.0"?><c:shop xmlns:c="urn:x"><c:list>
<c:item id="1" note=""><c:name lang="en"> A &amp; B </c:name><c:price> </c:price><c:x><c:y>1</c:y><c:y>2</c:y></c:x></c:item>
<c:item id="2"><c:x/><c:x><c:y u="kg">3</c:y></c:x><c:name>second</c:name><c:name>third</c:name></c:item></c:list></c:shop>"""


def test_xml_rows(spark, tmp_path):
    base = put(tmp_path, "a.xml", XML)
    got = markup.read_xml(spark, base, row_xpath="./c:list/c:item", fields={
        "id": "@id", "note": "@note", "name": "c:name/text()", "price": "c:price", "y": "./c:x/c:y", "unit": "c:x/c:y/@u", "gone": "zz"})
    assert bag(got) == sorted([("1", None, "A & B", None, "1", None, None), ("2", None, "second", None, "3", "kg", None)], key=repr)


def test_xml_in_a_column(frame):
    df = frame([(1, "<o k='7'><n> x </n></o>"), (2, "<o><n> </n></o>")], "i int, x string")
    assert bag(markup.xml_fields(df, "x", {"n": "n", "k": "@k"}, ["i"])) == sorted([(1, "x", "7"), (2, None, None)], key=repr)


def test_html_tables(spark, frame, tmp_path):
    page = ("<p>x</p><table><tr><th>a<th>b</tr><tr><td>1 &amp; <b>2</b><td><table><tr><td>inner</td></tr></table></tr></table>"
            "<TABLE><TR><TD>second</TD></TR></TABLE>")
    df = frame([(1, page), (2, "<p>none</p>"), (3, None)], "k int, html string")
    rows = lambda **o: [(r.k, r.row_no, r.cells) for r in markup.html_tables(df, "html", ["k"], **o).orderBy("k", "row_no").collect()]
    assert rows() == [(1, 0, ["a", "b"]), (1, 1, ["1 & 2", "inner"])]
    assert rows(table_index=1) == [(1, 0, ["inner"])]
    assert rows(table_index=2) == [(1, 0, ["second"])] == rows(match="^sec")
    assert rows(table_index=5) == []
    base = put(tmp_path, "p.html", page)
    assert markup.read_html(spark, base, table_index=2).head()["cells"] == ["second"]


def test_workbooks(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes([["Id", "Name", "name."], ["1", "x", "nan"], ["None", None, "<NA>"], ["3", None, "z"]], "S1"))
    rows = workbooks.read_xlsx(spark, str(tmp_path))
    assert [(r.sheet, r.row_no, r.cells) for r in rows.orderBy("row_no").collect()] == [
        ("S1", 0, {"Id": "1", "Name": "x", "name._1": None}), ("S1", 2, {"Id": "3", "Name": None, "name._1": "z"})]
    assert workbooks.sheet_table(rows, ["Id", "absent"], keep=[]).columns == ["Id", "absent"]
    assert workbooks.read_xlsx(spark, str(tmp_path), sheets=["other"]).count() == 0


def test_table_and_extract(spark, frame):
    frame([(1,), (2,)], "a int").createOrReplaceTempView("t_src")
    assert tables.read_table(spark, "t_src").count() == 2
    assert tables.read_table(spark, sql="SELECT * FROM t_src WHERE a > :n", params={"n": 1}).count() == 1
    with pytest.raises(ValueError):
        tables.read_table(spark)
    with pytest.raises(TypeError):
        tables.run_extract(spark, lambda s: [1])
    with pytest.raises(KeyError):
        tables.run_extract(spark, lambda s: {"a": s.range(1)}, {"b": "x"})


def test_generated_rows_are_fixed(spark):
    made = tables.synthetic(spark)
    assert made["customers"].count() == 100 and made["orders"].count() == 300
    assert bag(made["orders"]) == bag(tables.synthetic(spark)["orders"].repartition(7))
    bounds = made["orders"].agg(F.min("amount"), F.max("amount"), F.count_distinct("status")).head()
    assert bounds[0] >= 10 and bounds[1] <= 500 and bounds[2] == 3
    assert made["extraction_metadata"].head()["order_count"] == 300


def test_union_by_name(frame):
    got = files.union_tables([frame([(1, "x")], "a int, b string"), frame([("y", 2)], "b string, c int")])
    assert bag(got) == sorted([(1, "x", None), (None, "y", 2)], key=repr)


def test_file_column_in_every_reader(spark, tmp_path):
    put(tmp_path, "a.csv", "k,v\n1,x\n")
    put(tmp_path, "b.csv", "v,w\nfalse,2\n")
    put(tmp_path, "a.jsonl", '{"k": 1}\n')
    put(tmp_path, "a.json", '{"d": [{"k": 1}]}')
    put(tmp_path, "a.yaml", "d: [{k: 1}]")
    put(tmp_path, "a.xml", "<d><r k='1'/></d>")
    base = str(tmp_path)
    frames = [delimited.read_csv(spark, base, "a.csv", file_column="f"), documents.read_jsonl(spark, base, file_column="f"),
              documents.read_json(spark, base, json_path="d", file_column="f"), documents.read_yaml(spark, base, json_path="d", file_column="f"),
              markup.read_xml(spark, base, row_xpath="r", fields={"k": "@k"}, file_column="f")]
    for df, name in zip(frames, ["a.csv", "a.jsonl", "a.json", "a.yaml", "a.xml"]):
        assert [(str(r.k), r.f.rsplit("/", 1)[-1]) for r in df.collect()] == [("1", name)]
    with pytest.raises(Exception):
        delimited.read_csv(spark, base).collect()  # headers differ
    mixed = delimited.read_csv_layouts(spark, base)
    assert bag(mixed.select("k", "v", "w")) == sorted([(1, "x", None), (None, "false", 2)], key=repr)


def test_layouts_of_files_with_odd_names(spark, tmp_path):
    for name, text in (("a b.csv", "x,y\n1,2\n"), ("c%20d.csv", "y;x\n3;4\n"), ("e[1]+{f}.csv", "x,y\n5,6\n"), ("g*.csv", "z\n7\n")):
        put(tmp_path, name, text)
    got = delimited.read_csv_layouts(spark, str(tmp_path))
    assert {(r["_file"].rsplit("/", 1)[-1], r.x, r.y, r.z) for r in got.collect()} == {
        ("a b.csv", 1, 2, None), ("c%20d.csv", 4, 3, None), ("e[1]+{f}.csv", 5, 6, None), ("g*.csv", None, None, 7)}


def test_types_come_from_all_rows_and_cells_may_break_lines(spark, tmp_path):
    put(tmp_path, "late.csv", "a\n" + "1\n" * 3_000 + "1.5\n")
    late = delimited.read_csv(spark, str(tmp_path), "late.csv")
    assert dict(late.dtypes)["a"] == "double" and late.count() == 3_001
    put(tmp_path, "broken.csv", 'k,t\n1,"two\nlines"\n2,one\n')
    rows = delimited.read_csv(spark, str(tmp_path), "broken.csv", multi_line=True).collect()
    assert [(r.k, r.t) for r in rows] == [(1, "two\nlines"), (2, "one")]
    with pytest.raises(ValueError):
        delimited.read_csv(spark, str(tmp_path), "broken.csv", multi_line=True, skip_rows=1)


PATHS_XML = """<?xml version="1.0"?><root xmlns:x="urn:x"><active><item k="1"><id>a</id><tag>red</tag></item><item k="2"><id>b</id><tag>blue</tag><tag>red</tag></item>
<other><item k="9"><id>no</id></item></other><item><id>c</id></item></active><archive><item k="1"><id>d</id></item><x:item k="3">text <id> e </id></x:item></archive>
<active><item k="2"><id>f</id><tag/></item></active><active/></root>"""


@pytest.mark.parametrize("path,ids", [
    ("./active/item", ["a", "b", "c", "f"]), ("archive/item", ["d", "e"]), ("active/item[@k='1']", ["a"]), ('active/item[@k="2"]', ["b", "f"]),
    ("active/item[@k!='2']", ["a"]), ("active/item[@k]", ["a", "b", "f"]), ("active/item[tag]", ["a", "b", "f"]), ("active/item[tag='red']", ["a", "b"]),
    ("active/item[1]", ["a", "f"]), ("active/item[last()]", ["c", "f"]), ("active/item[last()-1]", ["b"]), ("active/item[tag='red'][2]", ["b"]),
    ("archive[item]/item", ["d", "e"]), ("active[other]/item[id='a']", ["a"]), (".//other/item", ["no"]), ("active/other/item[@k='9']", ["no"]),
    ("archive/x:item[2]", ["e"]), ("active/missing", []), ("other[item]/item", ["no"]),
])
def test_xml_row_paths(spark, tmp_path, path, ids):
    (tmp_path / "a.xml").write_text(PATHS_XML)
    got = markup.read_xml(spark, str(tmp_path), row_xpath=path, fields={"id": "id", "k": "@k"}, file_column="f").collect()
    assert sorted(r.id for r in got) == ids and all(r.f.endswith("a.xml") for r in got)


def test_xml_own_text_and_paths_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><s><v u='m'>1</v><v>2</v><v> </v></s></r>")
    got = markup.read_xml(spark, str(tmp_path), row_xpath="s/v", fields={"value": ".", "unit": "@u"}).collect()
    assert sorted(map(tuple, got), key=repr) == [("1", "m"), ("2", None), (None, None)]
    got = markup.read_xml(spark, str(tmp_path), row_xpath="s/v[.='2']", fields={"value": "text()"}).collect()
    assert [r.value for r in got] == ["2"]
    for bad in ("", "./", "s/*", "s/..", "s//v", "v[1]", "s/v[position()<2]", "s/v[@u='m'", "s/v[@u=m]"):
        with pytest.raises(ValueError):
            markup.read_xml(spark, str(tmp_path), row_xpath=bad, fields={"value": "."})
    with pytest.raises(ValueError):
        markup.read_xml(spark, str(tmp_path), row_xpath="s", fields={"value": "v[1]"})


def test_csv_types_by_a_vote_of_all_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,d,y,b,e,t,m\n1,1,2024-01-01,2024,true,,a,2024\n2,2.5,2024-02-01,2023-05-01,FALSE,,1,x\n-3,1e3,NA,2022-01-01,true,,2,2024-01-01\n")
    got = delimited.read_csv(spark, str(tmp_path))
    assert dict(got.dtypes) == {"n": "bigint", "x": "double", "d": "date", "y": "date", "b": "boolean", "e": "string", "t": "string", "m": "string"}
    assert [str(r.y) for r in got.orderBy("y").collect()] == ["2022-01-01", "2023-05-01", "2024-01-01"]
    assert "input_file" not in got._jdf.queryExecution().optimizedPlan().toString() and "_metadata" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shared_elements_are_read_as_whole_texts_are(spark):
    """Documents of which a task remembers elements give what Spark's parser gives, odd and broken ones too."""
    def doc(*children, head="<p n='7'>", tail="\n</p>"):
        return head + "".join(f"\n    {c}" for c in children) + tail

    kid, other = '<kid id="1">\n        <sub key="a"/>\n        <sub key="b">x</sub>\n    </kid>', '<kid id=" 2&lt;&#233; ">\n        <sub/>\n    </kid>'
    bare = "<kid>\n        <sub key=''/>\n    </kid>"
    texts = [doc(kid, other, kid), doc(bare, other), doc(bare), doc(), doc(tail="</p>"), doc(kid, tail="</p>"), "<p/>", '<p n="1"/>', doc(kid) + "\n ", doc("<note>1</note>", kid),
             doc(kid, "<kid id='3'>", other), doc(kid, "</kid>", "<kid>"), doc(kid, "<sub></kid>"), doc(kid, tail="\n</q>"), doc(kid) + "<p/>", doc(kid, head="<p><kid id='0'/></p>"),
             doc("<!--", kid, "-->", other), doc("<![CDATA[", kid, "]]>"), doc("<?x", kid, "?>"), doc("<a>", kid, "</a>"), doc("<a b='", kid, "'/>"), doc("<kid id='1' id='2'/>"),
             doc("<x:kid x:id='5'/>", kid), doc("<Kid ID='6'/>", kid), doc("<kid xmlns='u' id='8'/>"), doc("<kid id='&no;'/>"), doc("<kid id='9'>a & b</kid>", kid), "\ufeff" + doc(kid),
             " " + doc(kid), "", "text", "<p", None, doc(kid, "<kid id='\x01'/>"), doc("<kid id=\"a\nb\"/>"), doc("<é id='1'/>", kid), doc("<kid><kid id='4'/></kid>", "<sub key='z'/>")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(2)
    fields = {"n": "@n", "first": "kid/@id", "key": "kid/sub/@key", "kids": "count(kid/@id)", "subs": "count(kid/sub/@key)", "roots": "count(@n)"}
    whole, shared = ({r.i: tuple(r) for r in markup.xml_fields(df, "x", fields, ["i"], shared=s).collect()} for s in (False, True))
    assert whole == shared and whole[0] == (0, "7", "1", "a", 3, 4, 1) and whole[32] == (32, *[None] * 6)
    with pytest.raises(ValueError):
        markup.xml_fields(df, "x", {"n": "kid"}, shared=True)


def test_an_element_of_many_documents_is_parsed_once(monkeypatch):
    parsed, one = [], markup._Attributes.element
    monkeypatch.setattr(markup._Attributes, "element", lambda self, text, below: parsed.append(text) or one(self, text, below))
    reader = markup._Attributes([(["kid", "@id"], False), (["kid", "@id"], True)])
    kids = [f'<kid id="{i}">\n        <sub>{"x" * 99}</sub>\n    </kid>' for i in range(20)]
    for i in range(200):
        five = [(i + k) % 20 for k in range(5)]
        text = f'<p n="{i}">' + "".join(f"\n    {kids[k]}" for k in five) + "\n</p>"
        assert reader.document(text.encode()) == [str(five[0]), 5]
    assert sum(map(len, parsed)) < sum(map(len, kids)) + 200 * len('<p n="199">\n</p>')
    monkeypatch.setattr(markup, "REMEMBERED", 2_000)
    assert all(reader.document(f"<p>\n    <kid id='{i % 50}'/>\n</p>".encode()) == [str(i % 50), 1] for i in range(300)) and len(reader.known) < 5
