"""Every query with SQL agrees with DuckDB on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from twinframe import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
SOME = ["diff_summary", "value_diff_cells", "smart_preview", "hybrid_full_export", "column_mapped_diff", "renamed_columns_diff", "multi_column_wide_diff", "key_candidates_verdict", "null_key_handling", "unicode_clean", "text_normalize", "coerce_currency", "coerce_date", "profile_columns", "value_overlap"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_names_agree():
    assert set(queries.oracle_sql()) == set(queries.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    a = queries.queries()[name](spark, SF).toPandas()
    b = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def bag(df):
        df = df[sorted(df.columns)].astype(object)
        clean = lambda x: None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x)
        return Counter(tuple(map(clean, r)) for r in df.values.tolist())

    assert bag(a) == bag(b)
