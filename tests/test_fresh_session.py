"""Initial embeddings as the first work of a session, when columns have the lowest numbers."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from sylvagraph.code_queries import SQL

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
sf, out = sys.argv[1:]
"""
QUERY = """
from sylvagraph.code_queries import QUERIES
QUERIES["initial_embeddings"](spark, sf).toPandas().to_pickle(out)
"""
JOINED = """
from sylvagraph.operators import embeddings
from sylvagraph.sources import code
nodes = code.customer_code(spark, sf).nodes
found = embeddings.initial(nodes, 20, 3).join(nodes.select("graph_id", "node_id", embeddings.type_slot(nodes.tag).alias("own")), ["graph_id", "node_id"])
found.toPandas().to_pickle(out)
"""


def alone(work, tmp_path):
    out = str(tmp_path / "found")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "_PYSPARK"))} | {"PYTHONPATH": f"{REPO}:{os.environ.get('PYTHONPATH', '')}"}
    run = subprocess.run([sys.executable, "-c", RUN + work, SF, out], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    return pd.read_pickle(out)


@pytest.fixture(scope="module")
def expected():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    return con.execute(SQL["initial_embeddings"]).df().sort_values("node_id").reset_index(drop=True)


def test_query_is_first(tmp_path, expected):
    got = alone(QUERY, tmp_path).sort_values("node_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["node_id", "checksum", "slot"]], expected[["node_id", "checksum", "slot"]], check_exact=True)


def test_join_with_the_nodes_is_first(tmp_path, expected):
    got = alone(JOINED, tmp_path).sort_values("node_id").reset_index(drop=True)
    assert got.node_id.tolist() == expected.node_id.tolist()
    assert got.slot.tolist() == got.own.tolist() == expected.slot.tolist()
    sums = got.embedding.map(lambda e: sum(x * (i + 1) for i, x in enumerate(e)))
    assert (sums - expected.checksum).abs().max() < 1e-6
