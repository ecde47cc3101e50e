"""Cleaning, readers, flags and filters on hand-sized frames."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rarefind.operators import clean, project, scale
from rarefind.plans.reports import clean_csv
from rarefind.sources import scratch
from rarefind.sources.delimited import (
    drop_header_rows,
    header_names,
    read_raw_csv,
    read_typed_csv,
)


@pytest.fixture()
def csv_dir(tmp_path):
    for part, lines in {
        "a.csv": ['"Time","V1","Class"', '0,-1.5,"0"', '1,null,"1"'],
        "b.csv": ['"Time","V1","Class"', '2,1e3,"0"'],
    }.items():
        (tmp_path / part).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_raw_read_keeps_quotes_and_strips_names(spark, csv_dir):
    assert header_names(spark, csv_dir) == ["Time", "V1", "Class"]
    rows = sorted(tuple(r) for r in read_raw_csv(spark, csv_dir).collect())
    assert rows == [("0", "-1.5", '"0"'), ("1", "null", '"1"'), ("2", "1e3", '"0"')]


def test_header_rows_are_dropped_by_value(spark, csv_dir):
    raw = read_raw_csv(spark, csv_dir, ["Time", "V1", "Class"], header=False)
    assert raw.count() == 5
    assert drop_header_rows(raw).count() == 3


def test_clean_matches_typed_read(spark, csv_dir):
    cleaned = sorted(tuple(r) for r in clean.clean(read_raw_csv(spark, csv_dir)).collect())
    assert cleaned == [(0.0, -1.5, 0.0), (1.0, 0.0, 1.0), (2.0, 1000.0, 0.0)]
    typed = sorted(
        (tuple(r) for r in read_typed_csv(spark, csv_dir).collect()), key=lambda r: r[0]
    )
    assert typed == [(0.0, -1.5, 0.0), (1.0, None, 1.0), (2.0, 1000.0, 0.0)]


def test_line_of_wrong_length_stops_the_read(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_raw_csv(spark, str(tmp_path)).collect()


def test_only_exact_texts_change(spark):
    df = spark.createDataFrame([('"0"', "null"), ('"1"', "0"), ('"2"', "nullify")], "a string, b string")
    out = clean.null_text_to_zero(clean.strip_quoted_flags(df))
    assert [tuple(r) for r in out.collect()] == [("0", "0"), ("1", "0"), ('"2"', "nullify")]


@pytest.mark.parametrize("bad", ["", "x1", None])
def test_bad_number_stops_the_job(spark, bad):
    df = spark.createDataFrame([("1",), (bad,)], "a string")
    with pytest.raises(PySparkException, match="not a number"):
        clean.cast_all_double(df).collect()
    assert clean.bad_number_counts(df).first()["a"] == 1


def test_floor_of_negative_values(spark):
    df = spark.createDataFrame([(-1.5, 1.5)], "a double, b double")
    assert tuple(clean.floor_discretize(df, ["a"]).first()) == (-2.0, 1.5)


def test_flags_on_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (3.0,), (2.5,)], "V2 double")
    out = project.threshold_flags(df, [("V2", ">", 2.5), ("V2", "<", 2.6)][:1])
    assert [r["V2_"] for r in out.collect()] == [0, 0, 1, 0]
    with pytest.raises(ValueError):
        project.threshold_flags(df, [("V2", ">=", 1.0)])


def test_published_flags_and_drops_leave_36_inputs():
    columns = ["Time", *[f"V{i}" for i in range(1, 29)], "Amount"]
    kept = [c for c in columns if c not in project.PUBLISHED_DROPPED]
    assert len(kept) + len(project.PUBLISHED_FLAGS) == 36


def test_range_and_complement_drop_null(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,), (None,)], "r double")
    assert [r[0] for r in project.range_filter(df, "r", 0.2, 0.4).collect()] == [0.2]
    assert [r[0] for r in project.complement_filter(df, "r", 0.2, 0.4).collect()] == [0.1, 0.4]


def test_complement_of_other_values_is_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "Class double")
    assert [r["Normal"] for r in project.complement_label(df).collect()] == [1, 0, None, None]


def test_zscore_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    train, test = scale.zscore(df, df.limit(1), ["a", "b"])
    rows = [tuple(r) for r in train.collect()]
    assert [r[1] for r in rows] == [0.0, 0.0, 0.0]
    assert math.isclose(rows[0][0], -1 / math.sqrt(2)) and rows[2][0] is None
    assert test.count() == 1


def test_zscore_moments_follow_fit_on(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "a double")
    test = spark.createDataFrame([(10.0,)], "a double")
    assert scale.zscore(train, test, ["a"])[0].agg(F.sum("a")).first()[0] == pytest.approx(0)
    both = scale.zscore(train, test, ["a"], "all")
    assert both[0].unionByName(both[1]).agg(F.sum("a")).first()[0] == pytest.approx(0)
    with pytest.raises(ValueError):
        scale.zscore(train, test, ["a"], "test")


def test_class_weight(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,)], "Class double")
    assert sorted(r["weight"] for r in scale.class_weight(df).collect()) == [1.0, 1.0, 1.0, 5.0]
    with pytest.raises(ValueError):
        scale.positive_weight(df.filter("Class = 0"))


def test_shared_folder_follows_the_session(spark):
    class Conf:
        def get(self, key, default):
            return "/shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

    class Cluster:
        conf, sparkContext = Conf(), Context()

    assert scratch.shared_folder(Cluster()) == "/shared/checkpoints"
    Conf.get = lambda self, key, default: default
    with pytest.raises(ValueError):
        scratch.shared_folder(Cluster())
    Context.folder = "/set/by/hand"
    assert scratch.shared_folder(Cluster()) == "/set/by/hand"
    assert scratch.shared_folder(spark) == scratch.shared_folder(spark)


def _csv(tmp_path, *files):
    folder = tmp_path / "csv"
    folder.mkdir()
    for i, text in enumerate(files):
        (folder / f"{i}.csv").write_text(text)
    return str(folder)


GOOD = '"id","V1","V2"\n1,2,3\n'


@pytest.mark.parametrize("bad", ["4,5,6,7\n", "4,5\n"])
def test_lines_of_another_length_stop_every_read(spark, tmp_path, bad):
    path = _csv(tmp_path, GOOD + bad)
    for read in (read_raw_csv, read_typed_csv):
        with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
            read(spark, path).drop("V2").collect()
        with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
            read(spark, path).count()


def test_swapped_headers_stop_the_read(spark, tmp_path):
    path = _csv(tmp_path, GOOD, '"id","V2","V1"\n1,3,2\n')
    for columns in (["id", "V1", "V2"], ["V1"]):
        with pytest.raises(Exception, match="header"):
            read_raw_csv(spark, path).select(*columns).collect()


def test_good_files_read_with_plain_names(spark, tmp_path):
    path = _csv(tmp_path, GOOD, GOOD)
    assert read_raw_csv(spark, path).collect() == [("1", "2", "3")] * 2
    assert read_typed_csv(spark, path).select("V1").collect() == [(2.0,)] * 2


def test_missing_key_stops_the_cleaning(spark, tmp_path):
    with pytest.raises(Exception, match="no id|CAST_INVALID"):
        clean_csv(spark, _csv(tmp_path, GOOD + ",5,6\n"), ["id"])
