"""The queries of the corpus run over whole tables and have the columns asked for."""

from __future__ import annotations

import pytest

from tidemark.llm.queries import oracle_sql, queries

COLUMNS = {
    "p1_found": ["record_kind", "record_id", "start_pos", "end_pos"],
    "p2_found": ["record_kind", "record_id_a", "record_id_b"],
    "p4_found": ["section_id", "start_pos", "end_pos"],
    "p5_found": ["section_id_a", "section_id_b"],
    "p6_found": ["section_id", "cut_kind"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "start_pos", "lang_code"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs(name, spark, base):
    df = queries()[name](spark, base)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() >= (0 if name.startswith("p8") else 1)  # the smallest data hold no leak


def test_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
