import pytest

from lanternspark.llm import queries as Q

COLUMNS = {
    "p1_found": ["record_id_a", "record_id_b"], "p2_found": ["gen_id", "answer_column", "defect"], "p3_found": ["gen_id"], "p4_found": ["record_id_a", "record_id_b"],
    "p5_found": ["table_name", "row_id", "place", "pii_type"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    n = df.count()
    assert n > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.distinct().count() == n
        assert all(t == ("bigint" if c.endswith(("_id", "_id_a", "_id_b")) else "string") for c, t in df.dtypes)
