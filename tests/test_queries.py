"""Every query of the core equals its SQL, and those without SQL run."""

from __future__ import annotations

import pytest

from tests.oracle import check
from tidemark.plans import catalogue

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


def test_names_match():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, base):
    check(QUERIES[name], SQL[name], spark, base)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, base):
    assert QUERIES[name](spark, base).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["company_id", "section", "section_id", "prev_id", "jaccard_distance", "added_words", "removed_words"]


def test_core_does_not_need_the_corpus_package():
    import pathlib

    root = pathlib.Path(catalogue.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "tidemark.llm" not in f.read_text(), f
