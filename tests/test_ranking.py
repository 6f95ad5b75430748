import numpy as np
from oracle import assert_same, duck

from contrasta.operators import ranking as R
from contrasta.plans.catalogue import SQL, VECTORS
from contrasta.sources import tables as T


def test_nearest_over_several_cells(spark, tmp_path, monkeypatch):
    """Blocks smaller than the table, copies whose similarities tie, a label of one vector: as by sorting all pairs, and with no list sorted whole."""
    for name, n in (("VECTORS", 64), ("QUERIES", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(R, name, n)
    g = np.random.default_rng(5)
    base = g.normal(size=(40, 8)).round(2)
    rows = [(i, [float(x) for x in base[i % 40]], "alone" if i == 100 else f"l{i % 7 // 2}") for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").coalesce(1).write.parquet(f"{tmp_path}/out")
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    e, con = T.read(spark, str(tmp_path), "embeddings"), duck(tmp_path)
    q = e.where("vec_id % 50 = 0")
    assert_same(R.nearest(e, q, 12).select("query", "id", "rank", "hit"), con, "WITH " + VECTORS + " SELECT query, id, rank, hit FROM ranked WHERE rank <= 12")
    assert_same(R.first_hits(e, q).where("hit = 1").select("query", "rank"), con, "WITH " + VECTORS + " SELECT query, min(rank) AS rank FROM ranked WHERE hit = 1 GROUP BY query")
    assert R.first_hits(e, q).where("hit = 0").count() == 1
    from contrasta.plans.catalogue import QUERIES

    for name in ("mrr", "ndcg_at_k", "precision_at_k", "mean_ndcg"):
        assert_same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
