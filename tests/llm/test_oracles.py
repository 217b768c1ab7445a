"""The registered text queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tarnwave.llm import queries


def plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_contract_columns_come_first(spark, sf):
    first = {
        "op8_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op11_conversation_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
        "op12_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    }
    for name, columns in first.items():
        assert queries.QUERIES[name](spark, sf).columns[: len(columns)] == columns
