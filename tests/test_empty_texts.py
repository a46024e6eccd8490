"""Documents without a word, or without a text, against DuckDB."""

import duckdb

from tests.oracle import rows, spark_rows
from triplewright.plans import registry


def test_entities_without_aliases_have_no_row_text(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, CASE WHEN i % 3 = 0 THEN '' WHEN i % 3 = 1 THEN NULL ELSE 'word and ' || i END AS text FROM range(60) r(i)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = con.execute(registry.oracle_sql()["minimize_two_hops"])
    want = rows([c[0] for c in want.description], want.fetchall())
    assert any(r[2] is None and r[1] == "aliases" for r in want[1])
    assert spark_rows(registry.queries()["minimize_two_hops"](spark, str(tmp_path))) == want
