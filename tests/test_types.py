"""One column for each type rule, and the decisions on odd cases."""

from datetime import datetime

import pytest

from tabcast.operators import typing
from tabcast.sources import tables

COLUMNS = {
    "row_id": ("bigint", lambda i: i, "identifier", 11),
    "sale_date": ("string", lambda i: None if i in (3, 8) else f"2023-01-{i % 28 + 1:02d}", "date", 3),
    "when_txt": ("string", lambda i: f"2023-02-{i % 28 + 1:02d}", "date", 3),
    "bad_text": ("string", lambda i: "x" if i == 2 else f"2023-02-{i % 28 + 1:02d}", "text", 8),
    "annee": ("int", lambda i: 2019 + i % 5, "date", 1),
    "holiday_hours": ("int", lambda i: i % 5, "ordinal", 12),
    "promo": ("string", lambda i: None if i == 0 else (" non " if i % 2 else "Oui"), "binary", 4),
    "flag": ("boolean", lambda i: None if i == 0 else i % 2 == 0, "binary", 9),
    "flag01": ("int", lambda i: i % 2, "binary", 10),
    "two_val": ("double", lambda i: 1.5 if i % 2 else 2.5, "binary", 14),
    "satisfaction": ("string", lambda i: ("faible", "moyen", "fort", "autre")[i % 4], "ordinal", 5),
    "ref_client": ("string", lambda i: f"C{i:04d}", "identifier", 6),
    "zone": ("string", lambda i: "NSEW"[i % 4] * 2, "categorical", 7),
    "comment": ("string", lambda i: f"text {i % 38}", "text", 8),
    "rating": ("int", lambda i: i % 5 + 1, "ordinal", 12),
    "qty": ("int", lambda i: i % 30, "integer", 13),
    "price": ("double", lambda i: None if i < 3 else i * 1.1, "continuous", 15),
    "amount": ("decimal(10,2)", lambda i: None, "continuous", 15),
    "flat": ("double", lambda i: 7.0, "continuous", 15),
    "all_null": ("string", lambda i: None, "date", 3),
    "stamp": ("timestamp", lambda i: datetime(2024, 1, 1), "date", 2),
    "list": ("array<int>", lambda i: [i], None, None),
}


@pytest.fixture(scope="module")
def sample(spark):
    ddl = ", ".join(f"{c} {t[0]}" for c, t in COLUMNS.items())
    return spark.createDataFrame([tuple(t[1](i) for t in COLUMNS.values()) for i in range(40)], ddl)


def test_each_rule(sample):
    got = {r["column"]: (r["type"], r["rule"]) for r in typing.detect_types(sample).collect()}
    assert got == {c: (t[2], t[3]) for c, t in COLUMNS.items() if t[2]}


def test_sketch_agrees_on_small_tables(sample):
    exact = typing.type_map(typing.detect_types(sample))
    assert typing.type_map(typing.detect_types(sample, exact=False)) == exact


def test_batches_of_columns_agree(sample, monkeypatch):
    whole = {tuple(r) for r in typing.detect_types(sample).collect()}
    monkeypatch.setattr(typing, "COLUMNS_PER_PASS", 4)
    assert {tuple(r) for r in typing.detect_types(sample).collect()} == whole


def test_names_decide(spark):
    df = spark.createDataFrame([(f"A{i}",) for i in range(40)], "c string")
    assert typing.type_map(typing.detect_types(df)) == {"c": "text"}
    assert typing.type_map(typing.detect_types(df, {"c": "item_code"})) == {"c": "identifier"}


def test_long_texts_differ_beyond_any_prefix(spark):
    df = spark.createDataFrame([("x" * 500 + str(i),) for i in range(50)], "t string")
    assert typing.detect_types(df).first()["n_unique"] == 50


def test_explore_counts_raw_values(sample):
    rows = {r["column"]: r for r in typing.explore_table(sample).collect()}
    assert rows["promo"]["n_distinct"] == 2 and rows["promo"]["null_percent"] == 2.5
    assert rows["price"]["null_percent"] == 7.5
    assert rows["flag"]["advice"] == "compare the two groups or use as a class target"


def test_default_choices(sample):
    types = typing.type_map(typing.detect_types(sample))
    assert tables.default_target(types) == "flat"
    assert "row_id" not in tables.feature_columns(sample, types, "price")
    assert "comment" not in tables.feature_columns(sample, types, "price")
    assert tables.default_study(sample)["x"] == "row_id"


def test_csv_reading(spark, folder):
    text = (
        'id,name,when,mixed,amount,ok\n1,"a, b",2023-01-02,5,1.5,true\n2,"line\nbreak",2023-01-03,x,NA,false\n'
        '3,,2023-01-04,7,NaN,true\n4,null,2023-01-05,8,2,NA\n5,"say ""hi""",2023-01-06,9,3,true\n'
    )
    with open(f"{folder}/t.csv", "w") as out:
        out.write(text)
    df = tables.read_table(spark, f"{folder}/t.csv")
    assert dict(df.dtypes) == {
        "id": "bigint", "name": "string", "when": "string", "mixed": "string", "amount": "double", "ok": "boolean"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["name"] == "a, b" and rows[2]["name"] == "line\nbreak" and rows[5]["name"] == 'say "hi"'
    assert rows[3]["name"] is None and rows[4]["name"] is None
    assert rows[2]["amount"] is None and rows[3]["amount"] is None and rows[4]["ok"] is None
    assert tables.preview(df, "id", 2).count() == 2
    assert tuple(tables.shape(df).first()) == (5, 6)
