"""Queries with SQL give the SQL's rows; the others give rows, and the pipeline runs."""

from __future__ import annotations

import pytest

import __spark_entry__
from lodestone.llm import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
