"""Pairs within a radius, to the last digit."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumicell.operators import graphs
from lumicell.plans.all_queries import QUERIES, SQL


def test_distances_equal_the_sql_to_the_last_digit(spark, tmp_path):
    """Of so many pairs some hundred distances round to another sixth digit after the ninth, or end in 5 there."""
    xy = np.random.default_rng(3).uniform(-0.02, 0.03, (1500, 2)).astype("float32")
    pq.write_table(pa.table({"vec_id": np.arange(1500), "embedding": pa.array(list(xy), pa.list_(pa.float32())), "label": pa.array([0] * 1500, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT cell, neighbour, distance FROM ({SQL['spatial_radius']})").fetchall())
    got = sorted(map(tuple, QUERIES["spatial_radius"](spark, str(tmp_path)).select("cell", "neighbour", "distance").collect()))
    assert len(want) > 500_000 and got == want


def test_distances_that_round_to_the_radius(spark):
    """A grid as wide as the radius would have a column between the two."""
    places = spark.createDataFrame([(1, 0.2999999999, 0.0), (2, 0.6000000001, 0.0), (3, 0.600000002, 0.0)], "cell bigint, x double, y double")
    got = sorted((r.cell, r.neighbour, r.distance) for r in graphs.within_radius(places, 0.3).collect())
    assert got == [(1, 2, 0.3), (2, 1, 0.3)]
