import pytest

from tablemill.operators import headers
from tablemill.operators.headers import SkipTable


def columns(spark, *names):
    return spark.createDataFrame([tuple(range(len(names)))], ", ".join(f"c{i} int" for i in range(len(names)))).toDF(*names)


def test_normal_names(spark):
    df = columns(spark, " Order ID ", "Order-Id", "Größe (cm)", "%%", "order_id_1", "order id")
    assert headers.normalize_headers(df).columns == ["order_id", "order_id_2", "gr_e_cm", "col", "order_id_1", "order_id_3"]


def test_suffix_passes_over_taken_names():
    assert headers.unique_headers(["a", "A", "a_1", "a."]) == ["a", "A_2", "a_1", "a._3"]
    assert headers.unique_headers(["x  y.", "X Y", "z"]) == ["x  y.", "X Y_1", "z"]


def test_alias_resolution(spark):
    df = columns(spark, "Cust No.", "Signal  Description", "Extra")
    spec = [{"alias": ["customer", "cust no"], "as": "customer", "required": True},
            {"alias": [{"regex": "(signal )?description"}], "rename": "text"}, {"alias": "gone", "optional": True}]
    assert headers.pick_by_alias(df, spec).columns == ["customer", "text"]
    with pytest.raises(KeyError, match="gone"):
        headers.pick_by_alias(df, [{"alias": "gone", "optional": False}])


def test_require_columns_forms(spark):
    df = columns(spark, "Network Adress", "network address", "Other", "Note")
    both = headers.require_columns(df, {"network adress|network address": "address"}, optional={"note": None, "gone": "x"})
    assert both.columns == ["address"] or both.columns == ["address", "note"]
    assert [tuple(r)[0] for r in both.collect()] == [0]
    assert headers.require_columns(df, ["Other"]).columns == ["Other"]
    assert headers.require_columns(df, {"OTHER": "o"}, keep_extra=True).columns == ["Network Adress", "network address", "o", "Note"]
    assert headers.require_columns(df, {"Note": "~", "Other": "o"}).columns == ["Note", "o"]
    legacy = headers.require_columns(df, ["o"], alias_map={"other": "o"}, include_only=["o", "Note"])
    assert legacy.columns == ["o", "Note"]
    exact = headers.require_columns(df, {"Other": "o"}, normalize_source=False)
    assert exact.columns == ["o"]


def test_require_columns_modes(spark):
    df = columns(spark, "a")
    with pytest.raises(KeyError):
        headers.require_columns(df, ["b"])
    with pytest.raises(SkipTable):
        headers.require_columns(df, ["b"], mode="skip_table")
    empty = headers.require_columns(df, {"a": "x", "b|c": "y"}, mode="empty")
    assert empty.dtypes == [("x", "string"), ("y", "string")] and empty.count() == 0
    with pytest.raises(ValueError):
        headers.require_columns(df, ["a"], mode="what")


def test_patterns(spark):
    df = columns(spark, "b_id", "a_id", "a.name", "axname", "zz")
    assert headers.select_columns(df, ["*_id"]).columns == ["a_id", "b_id"]
    assert headers.select_columns(df, ["a.name"]).columns == ["a.name"]
    assert headers.match_columns(df.columns, "a.n?me") == ["a.name"]
    assert headers.match_columns(df.columns, "^a") == ["a_id", "a.name", "axname"]
    assert headers.match_columns(df.columns, "(a|b)_") == ["b_id", "a_id"]  # anchored at the start only
    assert headers.select_columns(df, None, ["a*"]).columns == ["b_id", "zz"]
    assert headers.select_columns(df, ["nothing"]).columns == df.columns


def test_dynamic_select(frame):
    df = frame([(2, "x", "9", "5"), (1, "x", "7", "8"), (0, "y", "8", "8")], "no int, kind string, conf_a string, conf_b string")
    pick = lambda **c: headers.dynamic_select(df, pattern="conf_*", output_name="conf", order_by=["no"],
                                              match_row={"kind": "x"}, condition=c, keep_columns=["no"])
    rows = lambda d: {r.no: r.conf for r in d.collect()}
    assert rows(pick(operator="==", value="8")) == {2: "5", 1: "8", 0: "8"}
    assert rows(pick(operator=">=", value=8))[2] == "5"
    assert rows(pick(operator="==", value="nothing"))[2] == "9"  # falls back to the first candidate
    assert rows(pick(type="regex", value="^8"))[2] == "5"
    assert rows(pick(operator="contains", value="7"))[2] == "9"
    with pytest.raises(ValueError, match="no row"):
        headers.dynamic_select(df, pattern="conf_*", output_name="c", order_by=["no"], match_row={"kind": "q"})
    with pytest.raises(ValueError, match="no column"):
        headers.dynamic_select(df, pattern="zzz*", output_name="c", order_by=["no"])
