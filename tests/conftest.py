import tempfile

import pytest

from leafmill.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-test-"))
    return s


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"create view {t} as select * from read_parquet('{p}')")
    return con


def rows_of(table, columns):
    norm = lambda v: round(v, 6) if isinstance(v, float) else None if v is None else str(v)
    return sorted((tuple(norm(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="session")
def same_as_oracle(spark, duck):
    def check(query, sql):
        got, want = query(spark, SF).toArrow(), duck.sql(sql).to_arrow_table()
        columns = sorted(got.column_names)
        assert columns == sorted(want.column_names)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
