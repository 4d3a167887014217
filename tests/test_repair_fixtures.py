"""Repair and verification rules."""

from pyspark.sql import functions as F

from helpers import make_lines
from seamfix.operators import repair as R


def _run(spark, files, plans, fixes=()):
    lines = make_lines(spark, files)
    plan = spark.createDataFrame(
        [(fid, d, h, ex, True) for fid, (d, h, ex) in plans.items()],
        "file_id long, delimiter string, header_row long, executor string, approved boolean")
    fx = spark.createDataFrame(list(fixes), "file_id long, row_number long, repaired_text string")
    res = R.apply_repairs(lines, plan, fx)
    out = {}
    for r in res["out"].orderBy("file_id", "line_no").collect():
        out.setdefault(r["file_id"], []).append(r["text"])
    files_v = {r["file_id"]: r for r in res["files"].collect()}
    errors = {}
    for r in res["errors"].orderBy("row_number").collect():
        errors.setdefault(r["file_id"], []).append(r["error"])
    return out, files_v, errors, res


def test_whole_file_and_row_level(spark):
    files = {
        1: "probe;city;level\n7;Turku;3\n8;Oslo;4",
        2: "probe,city,level,unit,shore\n7,Turku,3,cm,north\n8;Oslo;4,cm,north",
        4: "probe,city,level\n7,Turku,3\n8,Oslo,",
        5: "log\nprobe,city,level\n7,Turku,3\n8,Oslo",
        6: "7,Turku,3\n8,Oslo",
        7: "\ufeff\u200bprobe,city\nP7,Turku\nP8,St. John's",
        8: "7,Turku,3\n8,Oslo,4",
        9: "probe,city,level\n7,Turku,3\n8;Oslo;4\n9;Riga;5",
        10: "QWXZ\nPLMK\nprobe;city|level\n7,Turku,3\n8,Oslo,4",
        11: 'probe;city;level\n7;"Turku; Abo";3\n8;"Oslo, C";4',
    }
    plans = {1: (";", 0, "whole_file"), 2: (",", 0, "whole_file"), 4: (",", 0, "whole_file"),
             5: (",", 1, "whole_file"), 6: (",", None, "whole_file"), 7: (",", 0, "whole_file"),
             8: (",", None, "whole_file"), 9: (",", 0, "row_level"), 10: (",", 2, "row_level"),
             11: (";", 0, "whole_file")}
    fixes = [(9, 3, "8,Oslo,4"), (10, 3, "probe,city,level")]
    out, fv, errors, _ = _run(spark, files, plans, fixes)
    assert out[1] == ["probe,city,level", "7,Turku,3", "8,Oslo,4"]
    assert 2 not in out and errors[2] == ["row 3: expected 5 fields, found 3"]
    assert out[4][-1] == "8,Oslo,"  # an empty last field counts
    assert 5 not in out and errors[5] == ["row 4: expected 3 fields, found 2"]
    assert 6 not in out and errors[6] == ["row 2: expected 3 fields, found 2"]
    assert out[7][0] == "probe,city"
    assert out[8] == ["0,1,2", "7,Turku,3", "8,Oslo,4"]
    assert 9 not in out and not fv[9]["applied"]  # unflagged bad row: refuse all
    assert out[10] == ["probe,city,level", "7,Turku,3", "8,Oslo,4"]
    assert out[11] == ["probe,city,level", "7,Turku; Abo,3", '8,"Oslo, C",4']


def test_header_row_out_of_range(spark):
    out, fv, _, _ = _run(spark, {1: "a,b\n1,2"}, {1: (",", 5, "row_level")})
    assert fv[1]["error"] == "header_row_out_of_range" and 1 not in out


def test_verify_output(spark):
    rows = [(3, 1, "probe,city,level"), (3, 2, "7,Turku,3"), (3, 3, "8,Oslo"),
            (4, 1, "probe,city,level"), (4, 2, "7,Turku,3"), (4, 3, "8,Oslo,"),
            (5, 1, "\u200bprobe,x"), (5, 2, "1,2"), (6, 1, "single"), (6, 2, "x"),
            (8, 1, "probe;city"), (8, 2, "7;Turku, Abo")]
    df = spark.createDataFrame(rows, "file_id long, line_no long, text string")
    broken = spark.sql("select 9L file_id, 1L line_no, 'a,b' text union all select 9L, 2L, cast(X'31 2C E9' as string)"
                       .replace("X'31 2C E9'", "X'312CE9'"))
    v = {r["file_id"]: r for r in R.verify_output(df.unionByName(broken)).collect()}
    assert not v[3]["verified"] and v[4]["verified"]
    assert "invisible_characters_in_output_columns" in v[5]["errors"]
    assert "single_column_result" in v[6]["errors"]
    assert not v[8]["verified"] and v[9]["errors"] == ["output is not valid UTF-8"]
    gated = spark.createDataFrame([(4, ";", "whole_file"), (8, ";", "row_level")], "file_id long, delimiter string, executor string")
    v = {r["file_id"]: r["verified"] for r in R.verify_output(df, R.output_delimiters(gated)).collect()}
    assert v[4] and v[8]  # row-level output keeps the file's delimiter


def test_missing_output_and_immutability(spark):
    files = spark.createDataFrame([(1,), (2,)], "file_id long")
    verified = spark.createDataFrame([(1,)], "file_id long")
    miss = R.missing_output(files, verified).collect()
    assert [(r["file_id"], r["error"]) for r in miss] == [(2, "no_repaired_output_to_verify")]
    before = spark.createDataFrame([("a", "h1"), ("b", "h2")], "file_id string, sha256 string")
    assert R.source_unchanged(before, before).filter("not unchanged").count() == 0
    after = before.withColumn("sha256", F.when(F.col("file_id") == "b", "h3").otherwise(F.col("sha256")))
    assert R.source_unchanged(before, after).filter("not unchanged").count() == 1
