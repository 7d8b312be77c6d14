"""The queries over the smallest tables, with their exact columns."""

from __future__ import annotations

import pytest

import __spark_entry__

COLUMNS = {
    "p2_found": ["article_id_a", "article_id_b"], "p3_found": ["record_kind", "record_id", "field"], "p4_found": ["article_id", "lang"], "p5_found": ["article_id", "line_no"], "p6_found": ["article_id", "line_no"],
    "p7_found": ["record_kind", "record_id", "field"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_types(spark, data, name):
    df = __spark_entry__.queries()[name](spark, data)
    assert df.columns == COLUMNS[name]
    assert all(t in ("bigint", "string", "array<int>") for _, t in df.dtypes)
    rows = df.collect()
    keys = [tuple(r) for r in rows] if name != "p8_ids" else [r.doc_id for r in rows]
    assert len(keys) == len(set(keys))
