import random

from contrasta.sources import dictionary as D


def test_dense_sorted_ids(spark):
    r = random.Random(4)
    rows = [(f"n{r.randint(0, 400)}", r.choice("pq"), f"n{r.randint(0, 400)}") for _ in range(900)] + [("é", "p", "Z"), (None, "p", "n1")]
    t = spark.createDataFrame(rows, "s string, p string, o string").repartition(7)
    terms = D.encode(t)
    got = {x.term: x.id for x in terms.collect()}
    want = sorted({y for x in rows for y in x if y is not None}, key=lambda s: s.encode())
    assert got == {term: i for i, term in enumerate(want)}
    back = {i: term for term, i in got.items()}
    edges = D.encoded(t, terms)
    assert sorted((back[e.s], back[e.p], back[e.o]) for e in edges.collect()) == sorted(x for x in rows if None not in x)
    graph = D.Adjacency.write(edges)
    assert graph.read().count() == 2 * (len(rows) - 1)
    some = [got["n1"], got["Z"]]
    near = sorted((back[x.owner], back[x.p], x.out, back[x.other]) for x in graph.of(some).collect())
    assert near == sorted([(s, p, True, o) for s, p, o in rows if s in ("n1", "Z")] + [(o, p, False, s) for s, p, o in rows if o in ("n1", "Z") and s])
    assert "PushedFilters: [In(owner" in graph.of(some)._jdf.queryExecution().toString().replace("IsNotNull(owner), ", "")
    looked = {x.turn: x.id for x in D.batched(terms, spark.createDataFrame([(0, "Z"), (1, "nobody")], "turn int, term string")).collect()}
    assert looked == {0: got["Z"], 1: None}


def test_no_triples(spark):
    t = spark.createDataFrame([], "s string, p string, o string")
    assert D.encode(t).count() == 0


def test_ids_are_looked_up_once(spark):
    """Predicates need no shuffle of the triples, and an adjacency reads written ids: sampling its ranges repeats no join."""
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a"), ("a", "q", "a")], "s string, p string, o string")
    edges = D.encoded(t, D.encode(t))
    assert edges._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 2
    assert sorted(tuple(x) for x in edges.collect()) == [(0, 2, 1), (0, 3, 0), (1, 2, 0)]
    reads = []
    explode, D.written = D.written, lambda df: reads.append(df) or explode(df)
    try:
        graph = D.Adjacency.write(edges)
    finally:
        D.written = explode
    assert len(reads) == 1 and graph.read().count() == 6
