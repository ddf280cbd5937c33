"""Part keys of more than five digits share references: the queries and their SQL twins say the same there."""

import duckdb
import pytest

from lotwise.plans import more, queries, segments  # noqa: F401  they register the queries
from lotwise.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(tiny, tmp_path_factory):
    """Four copies of the tiny tables' first suppliers, the parts of two of them under references of others, one under 15202ST."""
    d, con = tmp_path_factory.mktemp("long-keys"), duckdb.connect()
    shift = "CASE i WHEN 0 THEN 0 WHEN 1 THEN 100000 WHEN 2 THEN 1000000 ELSE 152000 END"
    con.execute(f"COPY (SELECT l.* REPLACE (l_orderkey + i * 1000000 AS l_orderkey, CAST(l_partkey + {shift} AS BIGINT) AS l_partkey) FROM '{tiny}/lineitem.parquet' l, range(4) r(i) WHERE l_suppkey < 3 OR i = 3 AND l_partkey BETWEEN 15 AND 35) TO '{d}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT p.* REPLACE (CAST(p_partkey + {shift} AS BIGINT) AS p_partkey) FROM '{tiny}/part.parquet' p, range(4) r(i)) TO '{d}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (FROM '{tiny}/supplier.parquet') TO '{d}/supplier.parquet' (FORMAT parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["p22_extract_segment", "f3_prefiltered_match", "p17_suspicious_issues"])
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tables}/{t}.parquet'")
    got = QUERIES[name](spark, tables)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
