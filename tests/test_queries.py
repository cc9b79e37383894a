"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as job
import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_contract():
    assert set(job.oracle_sql()) <= set(job.queries())


def test_entry(spark):
    assert job.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(job.queries()))
def test_query(spark, con, name):
    assert check.compare(spark, con, FOLDER, name) == ""
