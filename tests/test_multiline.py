"""Multi-line CSV cut by many tasks equals Spark's reader, which takes a task per file."""

from contextlib import contextmanager

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospectra.sources import landing, multiline


@contextmanager
def tiny_splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in names:
            spark.conf.unset(k)


def whole(spark, path, sep=";"):
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE").csv(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def quoted(value):
    return '"' + value.replace('"', '""') + '"'


_PLAIN = st.text(st.sampled_from("ab é漢\t'"), max_size=4).map(lambda t: t.strip(" \t") or "x")
_FIELD = st.one_of(_PLAIN, st.just(""), st.text(st.sampled_from('ab;,"\n\r 漢'), max_size=12).map(quoted))
_FILE = st.tuples(st.lists(st.tuples(_FIELD, _FIELD, _FIELD), max_size=12), st.sampled_from(["\n", "\r\n"]), st.booleans())


def written(content):
    records, end, closed = content
    lines = ["A;b b;c", *[";".join(r) for r in records]]
    return (end.join(lines) + (end if closed else "")).encode()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_FILE, min_size=1, max_size=2), st.sampled_from([16, 33, 100, 100_000]))
def test_equals_sparks_reader(spark, tmp_path_factory, files, size):
    folder = tmp_path_factory.mktemp("csv")
    for i, content in enumerate(files):
        (folder / f"{i}.csv").write_bytes(written(content))
    with tiny_splits(spark, size):
        got = landing._read_records(spark, str(folder), ";")
        want = whole(spark, str(folder))
        assert got.columns == want.columns
        assert rows(got) == rows(want)


def test_a_record_longer_than_many_splits(spark, tmp_path):
    text = "".join(f'line {i} says ""no""\n' for i in range(60))
    (tmp_path / "a.csv").write_text(f'id;note\n1;"{text}"\n2;"x"\n3;"{text}{text}"\n')
    with tiny_splits(spark, 150):
        got = landing.read_csv(spark, str(tmp_path), ";", T.StructType().add("id", T.IntegerType()), multi_line=True)
        note = text.replace('""', '"')
        assert rows(got) == [(1, note), (2, "x"), (3, note + note)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as f:
        f.write("id;note\n")
        for i in range(20_000):
            f.write(f'{i};"first\nsecond ""{i}"""\n')
    with tiny_splits(spark, 32_768):
        df = landing.read_csv(spark, str(tmp_path), ";", T.StructType().add("id", T.LongType()), multi_line=True)
        assert df.rdd.getNumPartitions() > 8
        assert df.where(F.col("note") == F.concat(F.lit('first\nsecond "'), "id", F.lit('"'))).count() == 20_000


def test_without_broadcast(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note\n' + "".join(f'{i};"a\nb;{i}"\n' for i in range(200)))
    with tiny_splits(spark, 50):
        got = multiline.records(spark, str(tmp_path), broadcast_splits=0)
        assert sorted(r[0] for r in got.where("not first").collect()) == sorted(f'{i};"a\nb;{i}"' for i in range(200))


def test_types_are_inferred(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i;l;d;day;at;yes;s;none\n1;5000000000;1.5;2024-01-31;2024-01-31 10:00:00;true;"a\nb";\n'
                                    '2;1;2;2024-02-01;2024-02-01 11:30:00;false;7;\n')
    got = landing.read_csv(spark, str(tmp_path), ";", multi_line=True)
    assert [f.dataType.simpleString() for f in got.schema.fields] == [
        "int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    want = spark.read.options(header=True, sep=";", quote='"', escape='"', multiLine=True, inferSchema=True).csv(str(tmp_path))
    assert rows(got) == rows(want) and got.dtypes == want.dtypes


@pytest.mark.parametrize("content", ["", "a;b\n", "a;b", '﻿a;b\n1;"2\n3"\n'])
def test_few_rows(spark, tmp_path, content):
    (tmp_path / "a.csv").write_text(content)
    (tmp_path / "b.csv").write_text("a;b\n")
    assert rows(landing._read_records(spark, str(tmp_path / "*.csv"), ";")) == rows(whole(spark, str(tmp_path / "*.csv")))
