import pytest
from pyspark.sql import functions as F

from assay.functions.columns import clean_input
from assay.operators import validate
from assay.sources import history, naming, tables


def write(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data)
    return str(p)


def test_names_are_cleaned_and_told_apart():
    assert naming.unique_names(["First Name", "first name", "Weird!!Col"]) == ["first_name", "first_name_1", "weird_col"]
    assert naming.unique_names(["a", "a", "a_1", "%%", "__x__"]) == ["a", "a_1", "a_1_1", "column", "x"]


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_is_found(spark, tmp_path, sep):
    data = sep.join(["A", "b b", "C"]) + "\n" + sep.join(["1", "x", "2.5"]) + "\n" + sep.join(["2", '"q%sz"' % sep, "3.5"]) + "\n"
    df = tables.load_csv(spark, write(tmp_path, "t.csv", data.encode()))
    assert df.columns == ["a", "b_b", "c"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", 2.5), (2, f"q{sep}z", 3.5)]


def test_latin_and_marked_files_are_read(spark, tmp_path):
    latin = tables.load_csv(spark, write(tmp_path, "l.csv", "Stadt;n\nMünchen;1\n".encode("latin-1")))
    assert latin.first()["stadt"] == "München"
    marked = tables.load_csv(spark, write(tmp_path, "m.csv", b"\xef\xbb\xbfcity,n\nRome,1\n"))
    assert marked.columns == ["city", "n"]


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_csv(spark, write(tmp_path, "e.csv", b""))


def test_load_any_reports_and_validates(spark, tmp_path):
    path = write(tmp_path, "few.csv", b"a,b\n1,2\n1,2\n")
    loaded = tables.load_any(spark, path, "few.csv")
    assert loaded.metadata.first().asDict() == {"source_kind": "csv", "filename": "few.csv", "rows": 2, "cols": 2}
    v = loaded.validation.first()
    assert v["valid"] is False and "has 2 rows" in v["errors"][0] and v["warnings"] == ["1 row(s) repeat an earlier one in full."]


def test_largest_table_takes_the_first_of_equals_and_skips_unreadable(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    assert tables.largest_table({"a": a, "b": b, "c": b}).first()["name"] == "b"
    good = write(tmp_path, "g.csv", b"a,b\n1,2\n")
    assert tables.load_largest(spark, [str(tmp_path / "none.csv"), good]).count() == 1


def test_validation_of_gaps(spark):
    df = spark.createDataFrame(
        [(i, None, None if i < 7 else i, float("nan") if i < 5 else 1.0) for i in range(12)], "a int, b string, c int, d double"
    )
    v = validate.validate(df).first()
    assert v["valid"] and v["row_count"] == 12 and v["col_count"] == 4
    assert v["warnings"] == ["Columns without any value, which are left out: ['b']", "Columns with gaps in more than half of the rows: ['c']"]
    shares = {r["name"]: r["null_count"] for r in validate.missing_shares(df).collect()}
    assert shares == {"a": 0, "b": 12, "c": 7, "d": 5}


def test_empty_table_validates_without_failing(spark):
    df = spark.createDataFrame([], "a int, b string")
    v = validate.validate(df).first()
    assert v["valid"] is False and v["row_count"] == 0


@pytest.mark.parametrize("compare", ["fingerprint", "columns"])
def test_duplicates_count_nulls_as_equal_and_keep_shifted_nulls_apart(spark, compare):
    rows = [("x", None), (None, "x"), ("x", None), (None, None), (None, None)] + [("hot", "hot")] * 50
    df = spark.createDataFrame(rows, "a string, b string")
    assert validate.duplicate_rows(df, compare).first()[0] == 1 + 1 + 49


def test_nested_columns_become_text(spark):
    df = spark.range(1).select(F.array(F.lit(1), F.lit(2)).alias("a"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    assert tuple(clean_input(df).first()) == ("[1,2]", '{"k":1}')


def test_private_fields_are_dropped_at_every_level(spark):
    df = spark.range(1).select(
        "id", F.lit(1).alias("_X"), F.struct(F.lit(1).alias("a"), F.lit(2).alias("_b")).alias("s"),
        F.array(F.struct(F.lit(1).alias("_p"), F.lit(2).alias("q"))).alias("l"),
        F.create_map(F.lit("_k"), F.lit(1), F.lit("v"), F.lit(2)).alias("m"),
    )
    out = naming.strip_private(df)
    assert out.columns == ["id", "s", "l", "m"]
    assert out.first().asDict(recursive=True) == {"id": 0, "s": {"a": 1}, "l": [{"q": 2}], "m": {"v": 2}}


def runs(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("id"), "id").alias("id"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,id)").alias("created_at"),
        F.concat(F.lit("ds_"), "id", F.lit(".csv")).alias("dataset_name"), F.lit(5).alias("row_count"), F.lit(2).alias("col_count"),
        F.lit("why?").alias("business_question"), F.lit("# text").alias("report_text"),
        F.struct(F.lit("regression").alias("problem_type"), F.lit(1).alias("_pipeline")).alias("plan"),
        F.struct(F.lit(1).alias("r"), F.lit(9).alias("_X")).alias("results"), F.struct(F.lit(0.5).alias("cv")).alias("model_performance"),
    )


def test_sessions_round_trip(spark, tmp_path):
    path = str(tmp_path / "sessions")
    assert history.read_sessions(spark, path).count() == 0
    history.save_sessions(runs(spark, 3), path)
    stored = history.read_sessions(spark, path)
    listed = history.list_sessions(stored, 2).collect()
    assert [r["id"] for r in listed] == ["id2", "id1"] and len(listed[0]) == 7
    one = history.load_session(stored, "id1").select("id", F.to_json("plan").alias("plan"), F.to_json("results").alias("results")).first()
    assert one["plan"] == '{"problem_type":"regression"}' and one["results"] == '{"r":1}'
    assert history.load_session(stored, "nope").count() == 0


def test_broken_json_becomes_empty(spark, tmp_path):
    path = str(tmp_path / "sessions")
    history.session_rows(runs(spark, 1)).withColumn("plan_json", F.lit("{broken")).write.partitionBy("run_date").parquet(path)
    got = history.load_session(history.read_sessions(spark, path), "id0").select(F.to_json("plan").alias("p")).first()
    assert got["p"] == "{}"
