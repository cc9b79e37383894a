"""CSV files are split among tasks only where that gives the same rows."""

import pytest

from tabcast.sources import tables

PLAIN = 'id,name,note\n1,ann,x\n2,"bo, b","say ""hi"""\n3,,""\n4,"""q""",5\n'
SPLIT = {
    "plain": PLAIN,
    "windows": PLAIN.replace("\n", "\r\n"),
    "no last line end": PLAIN[:-1],
    "blank lines": PLAIN.replace("\n3", "\n\n3"),
    "doubled quotes in plain cells": PLAIN + '5,x""y,z\n',
}
WHOLE = {
    "line break in a cell": PLAIN + '5,"one\ntwo",z\n',
    "break after doubled quote": PLAIN + '5,"a"",\nb",z\n',
    "even quotes, open cell": PLAIN + '5,"a"b","c\nd"\n',
    "stray quote": PLAIN + '5,6" pipe,z\n',
    "blanks only": PLAIN + "   \n",
    "return within a line": PLAIN + "5,a\rb,z\n",
    "mixed line ends": PLAIN.replace("\n3", "\r\n3"),
}


def put(folder, text):
    folder.mkdir(exist_ok=True)
    path = folder / "part.csv"
    path.write_bytes(text.encode())
    return str(path)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("case", SPLIT)
def test_lines_that_are_records(spark, tmp_path, case):
    path = put(tmp_path / "in", SPLIT[case])
    assert tables.lines_are_records(spark, path)
    whole = tables.read_table(spark, path, multi_line=True)
    found = tables.read_table(spark, path)
    assert found.schema == whole.schema
    assert rows(found) == rows(whole)


@pytest.mark.parametrize("case", WHOLE)
def test_lines_that_may_not_be(spark, tmp_path, case):
    path = put(tmp_path / "in", WHOLE[case])
    assert not tables.lines_are_records(spark, path)
    assert rows(tables.read_table(spark, path)) == rows(tables.read_table(spark, path, multi_line=True))


def test_one_doubtful_file_decides_for_the_folder(spark, tmp_path):
    put(tmp_path / "in", PLAIN)
    (tmp_path / "in" / "other.csv").write_bytes(WHOLE["line break in a cell"].encode())
    folder = str(tmp_path / "in")
    assert not tables.lines_are_records(spark, folder)
    assert rows(tables.read_table(spark, folder)) == rows(tables.read_table(spark, folder, multi_line=True))


def test_large_files_are_split(spark, tmp_path):
    text = "id,name\n" + "".join(f'{i},"name {i}, ""x"""\n' for i in range(20_000))
    path = put(tmp_path / "in", text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 64 << 10)
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 10)
        found = tables.read_table(spark, path)
        # Both passes and the table itself are read by several tasks.
        assert found.rdd.getNumPartitions() > 4
        assert tables.read_table(spark, path, multi_line=True).rdd.getNumPartitions() == 1
        assert rows(found) == rows(tables.read_table(spark, path, multi_line=True))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
