"""JSON baselines: many lines, broken files, versions valid at a time."""

import datetime as dt

from seamfix.sources import baselines as B


def test_read_and_valid_version(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"table": "t", "version": 1, "valid_from": "2024-01-05",\n  "columns": [{"name": "x", "type": "int64", "nullable": false},\n'
                                     '   {"name": "y", "type": "string", "nullable": true}]},\n {"table": "t", "version": 3, "valid_from": "2024-02-01", "columns": []},\n'
                                     ' {"table": "t", "version": 2, "valid_from": "2024-02-01", "columns": [{"name": "z", "type": "bool", "nullable": true}]}]')
    (tmp_path / "b.json").write_text('{"table": "u", "version": 7, "valid_from": "2024-03-01",\n "columns": [{"name": "k", "type": "int64", "nullable": true}]}')
    (tmp_path / "c.json").write_text('{"table": "broken", ')
    (tmp_path / "d.json").write_text('{"table": "u", "version": 8, "valid_from": "soon", "columns": []}')
    b = B.read_baselines(spark, str(tmp_path))
    assert [r["error"] is not None for r in b.filter("table is null").collect()] == [True, True]
    day = lambda m, d: dt.date(2024, m, d)
    runs = spark.createDataFrame([("t", day(1, 4)), ("t", day(1, 5)), ("t", day(2, 9)), ("u", day(3, 2)), ("none", day(1, 1))], "table string, run_at date")
    got = {(r["table"], r["run_at"].date()): r["version"] for r in B.valid_versions(b, runs).collect()}
    assert got == {("t", day(1, 4)): None, ("t", day(1, 5)): 1, ("t", day(2, 9)): 3, ("u", day(3, 2)): 7, ("none", day(1, 1)): None}
    cols = sorted((r["table"], r["version"], r["ordinal"], r["name"]) for r in B.baselines_at(b, runs).collect())
    assert cols == [("t", 1, 1, "x"), ("t", 1, 2, "y"), ("u", 7, 1, "k")]


def test_written_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("t;1", 1, dt.date(2024, 1, 1), [("a b", "int64", True)]), ("t;1", 2, dt.date(2024, 1, 2), [("é", "string", False), ("q\"", "bool", True)])],
                                 "table string, version int, valid_from date, columns array<struct<name: string, type: string, nullable: boolean>>")
    path = B.write_baselines(docs, str(tmp_path / "out"))
    rows = B.read_baselines(spark, path + "/*/*.txt").collect()
    assert sorted((r["table"], r["version"], r["ordinal"], r["name"], r["type"], r["nullable"], r["error"]) for r in rows) == [
        ("t;1", 1, 1, "a b", "int64", True, None), ("t;1", 2, 1, "é", "string", False, None), ("t;1", 2, 2, 'q"', "bool", True, None)]
