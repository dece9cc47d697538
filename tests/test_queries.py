"""Every registered query of the main library against its SQL on the same tables, and a schema for those without."""

import math
import os

import duckdb
import pytest

from dialoglake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def plain(row):
    return [v.asDict(recursive=True) if hasattr(v, "asDict") else [x.asDict(recursive=True) if hasattr(x, "asDict") else x for x in v] if isinstance(v, list) else v for v in row]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, map(plain, df.collect()))
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    assert got == want
