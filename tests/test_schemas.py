"""Stated schemas: every table that a query names has one, and files that lack a column are refused."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from mediaweave import plans
from mediaweave.sources.schemas import GIVEN, LIBRARY, read_table, schema_of
from tests.test_oracles import SF_DIR


def test_every_table_that_a_query_names_has_a_schema():
    named = set()
    for module in Path(plans.__file__).parent.glob("*.py"):
        named |= set(re.findall(r'table\(\w+, \w+, "(\w+)"\)', module.read_text()))
    assert {"events", "lineitem", "documents"} <= named <= {*GIVEN, *LIBRARY}


@pytest.mark.parametrize("name", GIVEN)
def test_the_stated_columns_are_those_of_the_files(spark, name):
    files = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    assert [(f.name, f.dataType) for f in schema_of(name)] == [(f.name, f.dataType) for f in files.schema]


def test_a_missing_column_is_an_error(spark, tmp_path):
    spark.range(3).selectExpr("id AS vec_id", "1 AS label").write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="embedding"):
        read_table(spark, str(tmp_path / "t"), "embeddings")
