"""What the near-duplicate operators send to the driver: no table that grows with the input, whatever the planner takes for small."""

import random

import pytest

from tiergraph.llm import similar, simhash

LIMIT = "spark.sql.maxBroadcastTableSize"


@pytest.fixture
def tight(spark):
    spark.conf.set(LIMIT, "8m")
    yield spark
    spark.conf.unset(LIMIT)


def texts(n):
    """Distinct texts, and after each tenth a near copy."""
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.randrange(10**6)}" for _ in range(12))) for k in range(n)]
    return [*rows, *((n + k, rows[k][1] + " and") for k in range(0, n, 10))]


def test_grid_points_are_not_broadcast(tight):
    """Each fingerprint has 33 grid points, of which the planner's estimate knows nothing."""
    nodes = tight.range(6000).selectExpr("xxhash64(id) AS fp")
    assert simhash.links(nodes).count() == 0


def test_fingerprints_are_not_broadcast(tight):
    docs = tight.createDataFrame([(k, f"a{k} b{k} c{k}") for k in range(20_000)], "doc_id bigint, text string")
    found = simhash.near_components(docs)
    assert found.count() == 20_000


def test_near_copies_are_not_broadcast(tight):
    rows = texts(6000)
    docs = tight.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
    assert found == {k: k if k < 6000 else k - 6000 for k, _ in rows}
