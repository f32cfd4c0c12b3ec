"""Every operator against its oracle on the smallest tables, and hand-computed cases."""

import glob
import os

import duckdb
import pytest

from citygrid import catalog
from citygrid.graph import connected_components
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con(tmp_path_factory):
    c = duckdb.connect(config={"temp_directory": str(tmp_path_factory.mktemp("duck"))})
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    return round(float(v), 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name not in catalog.SQL:  # tested on fixtures
        assert df.count() > 0
        return
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_length_tags(spark):
    from citygrid.operators.attributes import metres

    rows = spark.createDataFrame([("12.5",), ("12,5 m",), ("41'6\"",), ("135 ft",), ("300 cm",), ("-4",), ("12;14",), ("tall",), (None,)], "t string")
    got = [r[0] and round(r[0], 4) for r in rows.selectExpr(metres("t")).collect()]
    assert got == [12.5, 12.5, 12.6492, 41.148, 3.0, None, 12.0, None, None]


def test_components(spark):
    edges = spark.createDataFrame([(5, 9), (9, 7), (2, 3), (4, 4), (None, 1), (3, 8), (8, 6)], "a long, b long")
    assert dict(connected_components(edges).collect()) == {5: 5, 9: 5, 7: 5, 2: 2, 3: 2, 8: 2, 6: 2}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_that_stop_early(spark):
    """A name never spans two components, whatever the number of rounds."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102)], "a long, b long")
    for rounds in (1, 2):
        names = dict(connected_components(edges, rounds=rounds).collect())
        assert set(names) == {*range(41), 100, 101, 102}
        assert all((v < 100) == (c < 100) for v, c in names.items())
    assert set(dict(connected_components(edges).collect()).values()) == {0, 100}


def test_components_of_a_path_in_order(spark, monkeypatch):
    """Names that rise along a path do not make a round for each edge."""
    from citygrid.lineage import Shelf

    written, put = [], Shelf.put
    monkeypatch.setattr(Shelf, "put", lambda self, name, df: written.append(name) or put(self, name, df))
    got = connected_components(spark.range(10_000).selectExpr("id AS a", "id + 1 AS b"))
    assert got.filter("component = 0").count() == 10_001
    assert sum(n.startswith("step") for n in written) <= 30
