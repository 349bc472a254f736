"""Series, types, errors and what frames gained with them, against known results."""

import datetime as dt
import sqlite3
from decimal import Decimal

import pyarrow as pa
import pytest

from tessera import ColumnNotFound, Frame, LengthMismatch, Series, TesseraError, col, from_series, kinds, sources


@pytest.fixture(autouse=True)
def session_first(spark):
    return spark


def test_constructors_and_getters():
    s = Series.of("a", [3, 0, -1], valid=[True, False, True])
    assert s.to_list() == [3, None, -1] and len(s) == 3 and s.null_count() == 1 and s.is_null_at(1) and not s.is_null_at(0)
    assert (s.get_int(0), s.get_int(1), s.get_float(0), s.get(-1)) == (3, None, None, -1)
    with pytest.raises(IndexError):
        s.get(3)
    assert Series.of("b", [True]).get_bool(0) is True and Series.of("b", [True]).get_int(0) is None
    assert Series.of("d", [Decimal("1.50")]).get_decimal(0) == Decimal("1.50")
    day, now = dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 1, 2, 3, 4)
    assert Series.of("d", [day]).get_date(0) == day and Series.of("t", [now]).get_datetime(0) == now and Series.of("t", [now]).get_date(0) is None
    assert Series.of("l", [dt.timedelta(hours=2)]).get_duration(0) == dt.timedelta(hours=2)
    assert Series.of("n", [None, None]).to_list() == [None, None] and Series.of("e", [], "int").to_list() == []


def test_names_types_and_arrow():
    s = Series.of("a", ["1", "x"]).rename("b").cast("int")
    assert s.name == "b" and kinds.kind(s.dtype) == "i32" and s.to_list() == [1, None]
    assert s.to_arrow().to_pylist() == [1, None] and s.to_frame().columns == ["b"]
    assert Series.from_arrow("c", pa.chunked_array([[1], [2]])).to_list() == [1, 2]


def test_slices():
    s = Series.of("a", list(range(10)))
    assert s.slice(2, 3).to_list() == [2, 3, 4] and s.slice(-2).to_list() == [8, 9] and s.slice(9, 5).to_list() == [9] and s.slice(20, 1).to_list() == []


def test_arithmetic_and_comparison():
    a, b, one = Series.of("a", [1, 2, None]), Series.of("b", [4, 5, 6]), Series.of("c", [10])
    assert (a + b).to_list() == [5, 7, None] and (a + one).to_list() == [11, 12, None] and (one - b).to_list() == [6, 5, 4]
    assert (a * 2).to_list() == [2, 4, None] and (b / a).to_list() == [4.0, 2.5, None] and (a + a).to_list() == [2, 4, None]
    assert (a < b).to_list() == [True, True, None] and (b == 5).to_list() == [False, True, False] and (one - b).name == "c"
    with pytest.raises(LengthMismatch):
        a + Series.of("d", [1, 2])


def test_aggregates_and_tests():
    s = Series.of("v", [1.0, float("nan"), None, float("inf")])
    assert s.is_nan().to_list() == [False, True, None, False] and s.is_not_nan().to_list() == [True, False, None, True]
    assert s.is_finite().to_list() == [True, False, None, False] and s.is_infinite().to_list() == [False, False, None, True]
    assert s.is_not_null().to_list() == [True, True, False, True] and s.max().to_list() == [float("inf")] and s.min().to_list() == [1.0]
    n = Series.of("n", [1, 2, 6])
    assert n.sum().to_list() == [9] and n.mean().to_list() == [3.0] and (n - n.mean()).to_list() == [-2.0, -1.0, 3.0]
    assert n.map(lambda v: v + 1).to_list() == [2, 3, 7]


def test_frames_of_series(spark):
    a, b = Series.of("a", [1, 2]), Series.of("b", ["x", "y"])
    f = from_series(a, b, Series.of("c", [9]))
    assert f.columns == ["a", "b", "c"] and [tuple(r) for r in f.collect()] == [(1, "x", 9), (2, "y", 9)]
    g = Frame(spark.createDataFrame([(2, "b"), (1, "a")], "k int, s string"), ["k"])
    assert g.column("s").to_list() == ["a", "b"] and g.column(0).get(0) == 1 and [s.name for s in g.get_columns()] == ["k", "s"]
    with pytest.raises(ColumnNotFound) as e:
        g.column("zz")
    assert isinstance(e.value, TesseraError) and isinstance(e.value, ValueError)
    with pytest.raises(LengthMismatch):
        from_series(a, Series.of("d", [1, 2, 3]))


def test_kinds(spark):
    t = kinds.struct_of({"a": kinds.list_of(kinds.plain("i32")), "b": kinds.decimal(10, 2), "c": kinds.datetime("UTC"), "d": kinds.duration()})
    assert kinds.text(t).startswith("struct<a:array<int>,b:decimal(10,2),c:timestamp") and list(kinds.fields(t)) == ["a", "b", "c", "d"]
    assert kinds.inner(kinds.fields(t)["a"]) == kinds.plain("i32") and kinds.decimal_info(kinds.fields(t)["b"]) == (10, 2) and kinds.decimal_info(t) is None
    assert kinds.time_zone(kinds.datetime("UTC")) == spark.conf.get("spark.sql.session.timeZone") and kinds.time_zone(kinds.datetime()) is None
    assert [kinds.kind(x) for x in kinds.fields(t).values()] == ["list", "decimal", "datetime", "duration"] and kinds.time_unit(kinds.duration()) == "us"
    assert kinds.to_arrow(kinds.plain("i64")) == pa.int64()
    with pytest.raises(ValueError):
        kinds.plain("u128")


def test_frames_gained(spark, tmp_path):
    f = Frame(spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (0, "c")], "k int, g string"), ["k"])
    assert [tuple(r) for r in f.group_by_stable("g").agg(col("k").sum()).collect()] == [("c", 0), ("a", 1), ("b", 5)]
    assert sorted(r["k"] for r in f.collect_streaming()) == [0, 1, 2, 3] and f.lazy() is f and f.schema_text() == "k: int\ng: string"
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert sources.read_csv_async(str(tmp_path / "a.csv")).result().to_dicts() == [{"x": 1, "y": 2}]
    f.df.write.parquet(str(tmp_path / "p"))
    assert sources.read_parquet_async(str(tmp_path / "p")).result().height() == 4
    assert sources.from_arrow(pa.array([1, None])).to_dicts() == [{"value": 1}, {"value": None}]
    assert sources.from_arrow(pa.array([{"a": 1, "b": "x"}])).columns == ["a", "b"]


def test_offsets_by_rows(spark):
    f = Frame(spark.createDataFrame([(dt.datetime(2024, 1, 31), b) for b in ("1mo", "-1h30m", "5ms", None)], "t timestamp_ntz, b string"))
    got = [r[0] for r in f.select(col("t").dt.offset_by(col("b"))).collect()]
    assert got == [dt.datetime(2024, 2, 29), dt.datetime(2024, 1, 30, 22, 30), dt.datetime(2024, 1, 31, 0, 0, 0, 5000), None]
    with pytest.raises(Exception, match="not a duration"):
        f.select(col("t").dt.offset_by(col("b") + "?")).collect()


def test_database_overrides(spark, tmp_path):
    at = str(tmp_path / "x.db")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE t (k INTEGER, d TEXT)")
    f = Frame(spark.createDataFrame([(1, Decimal("1.5")), (2, None)], "k int, d decimal(5,2)").coalesce(1))
    sources.write_dbapi(f, lambda: sqlite3.connect(at), "INSERT INTO t VALUES (?, ?)", overrides={"d": str})
    with sqlite3.connect(at) as c:
        assert c.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "1.50"), (2, None)]
    with pytest.raises(ColumnNotFound):
        sources.write_dbapi(f, lambda: sqlite3.connect(at), "INSERT INTO t VALUES (?, ?)", overrides={"zz": str})
