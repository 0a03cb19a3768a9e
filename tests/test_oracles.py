"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import corpusmill.plans.building as building
import corpusmill.plans.queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def candidates_once():
    """The queries over fused candidates share them, in these tests only."""
    made, retrieve = {}, plans._retrieved

    def once(spark, sf_dir):
        if sf_dir not in made:
            made[sf_dir] = retrieve(spark, sf_dir)
        return made[sf_dir]

    plans._retrieved = building._retrieved = once
    yield
    plans._retrieved = building._retrieved = retrieve


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(name, spark, duck):
    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
