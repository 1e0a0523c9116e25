"""Queries held to their SQL on tables made to be odd or to repeat."""

import pytest

from driftmark import queries as q

duckdb = pytest.importorskip("duckdb")


def differing(spark, root, name):
    """Rows of one side alone, by both."""
    q.QUERIES[name](spark, str(root)).write.mode("overwrite").parquet(f"{root}/out/{name}")
    con = duckdb.connect()
    for path in root.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    con.execute(f"CREATE TABLE want AS {q.ORACLES[name]}")
    con.execute(f"CREATE TABLE got AS SELECT {', '.join(r[0] for r in con.execute('DESCRIBE want').fetchall())} FROM '{root}/out/{name}/*.parquet'")
    assert con.execute("SELECT count(*) FROM want").fetchone()[0] > 0
    return [con.execute(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}").fetchall() for a, b in (("got", "want"), ("want", "got"))]


#: Keys whose places lie on the edge of two cells, where the last bit of the longitude decides.
EDGES = [21870, 44910, 46305, 62595, 67950, 85635]


@pytest.mark.parametrize("name", ["snapped_places", "healpix_cells"])
def test_places_on_the_edge_of_cells(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in [*range(1, 200), *EDGES]], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert differing(spark, tmp_path, name) == [[], []]
