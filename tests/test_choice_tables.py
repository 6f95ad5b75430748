"""The programs by tables of states, whole batches of items, against the search of one item."""

import random

import pyarrow as pa
import pytest

from contrasta.operators import choice_evidence as H

GROUP = pa.struct([("place", pa.int32()), ("family", pa.string()), ("node", pa.string()), ("own", pa.int32()), ("absent", pa.int32()), ("risk", pa.int32()), ("tier", pa.int32()), ("words", pa.int32()), ("alt", pa.int32()), ("lone", pa.bool_()), ("fixed", pa.bool_())])
BATCH = pa.schema([("item", pa.int64()), ("letters", pa.int32()), ("families", pa.list_(pa.string())), ("nodes", pa.list_(pa.string())), ("groups", pa.list_(GROUP))])


def item(r, n, names):
    """A given, and n groups, some of them of one node in several families."""
    given = H.Given(r.choice([0, 1, 3]), frozenset(r.sample("xyz", r.randint(0, 2))), frozenset(r.sample(names, r.randint(0, 2))))
    pairs = r.sample([(f, m) for f in "vwxyz" for m in names], n)
    groups = []
    for i, (family, node) in enumerate(pairs):
        own, kind = r.randint(1, 15), r.random()
        groups.append(H.Group(i, family, node, own, own.bit_count(), r.choice([0, 0, 1, 2]), r.choice([0, 0, 1]), r.randint(1, 3), r.randint(1, 4), (own & ~1) if kind < 0.25 else 0, kind > 0.25 and own == 1, kind > 0.95 and own != 1))
    return given, groups


def solved(items, program):
    fields = [f.name for f in GROUP]
    table = [{"item": i, "letters": g.letters, "families": sorted(g.families), "nodes": sorted(g.nodes), "groups": [{c: {"alt": x.alt, "lone": x.answer_only, "fixed": x.fixed}.get(c, getattr(x, c, None)) for c in fields} for x in some]} for i, (g, some) in enumerate(items)]
    return H._solve(pa.RecordBatch.from_pylist(table, BATCH), program).to_pylist()


@pytest.mark.parametrize("seed", range(12))
def test_after_as_searched(seed):
    r = random.Random(seed)
    order = r.sample(range(7), 7) if seed % 2 else list(range(7))
    budget, lone = r.randint(0, 5), r.randint(0, 2)
    # few names: nodes of several families, in some items more than states tell apart; many names: none
    items = [item(r, r.randint(0, 14), "pqrstu" if i % 2 else "abcdefghijklmnopqrstu") for i in range(24)]
    items += [item(r, 14, "abcdefghij") for _ in range(4)]
    for (given, groups), got in zip(items, solved(items, H.Program(*H.AFTER, budget, lone, order)), strict=True):
        status, chosen, _ = H.solve_after(groups, given, budget, lone, order, None)
        assert got["status"] == status
        assert got["chosen"] == (None if chosen is None else [g.place for g in chosen])
        assert got["key"] == (None if chosen is None else list(H.after_key(given, chosen)))


def test_items_beyond_the_table_are_searched(monkeypatch):
    """Items with more shared nodes than states tell apart are searched to the end, beside tabulated ones, with the same results."""
    r = random.Random(5)
    items = [item(r, 12, "pqrstu" if i % 2 else "abcdefghijklmnopqrstu") for i in range(12)]
    want = solved(items, H.Program(*H.AFTER, 5, 1, range(7)))
    monkeypatch.setattr(H, "SHARED", 1)
    got = solved(items, H.Program(*H.AFTER, 5, 1, range(7)))
    pick = lambda rows: [(x["status"], x["chosen"], x["key"]) for x in rows]
    assert pick(got) == pick(want) and got != want


@pytest.mark.parametrize("seed", range(12))
def test_before_as_searched(seed):
    r = random.Random(seed)
    order = r.sample(range(6), 6) if seed % 2 else list(range(6))
    budget = r.randint(0, 4)
    items = [(g, [H.Group(**{**x.__dict__, "fixed": False}) for x in some]) for g, some in (item(r, r.randint(0, 14), "abcdefghijklmnopqrstu") for _ in range(24))]
    for (given, groups), got in zip(items, solved(items, H.Program(*H.BEFORE, budget, 0, order)), strict=True):
        status, chosen, _ = H.solve_before(groups, given, budget, order, None)
        assert (got["status"], got["chosen"], got["key"]) == (status, [g.place for g in chosen], list(H.before_key(given, chosen)))


def test_many_groups_and_large_costs():
    """More groups than a number has bits, costs beyond 64 bits, and ties: the last of 300 groups is the best."""
    groups = [H.Group(i, f"f{i % 7}", f"n{i}", 7, 3, 1, 1, 10**6 - i, 10**6) for i in range(300)]
    got = solved([(H.Given(0, frozenset(), frozenset()), groups)], H.Program(*H.BEFORE, 1, 0, range(6)))[0]
    assert got["status"] == "OPTIMAL" and got["chosen"] == [299]
    tied = [H.Group(i, f"f{i % 7}", f"n{i}", 15, 4, 0, 0, 1, 1) for i in range(300)]
    got = solved([(H.Given(0, frozenset(), frozenset()), tied)], H.Program(*H.AFTER, 5, 1, range(7)))[0]
    assert got["chosen"] == [0, 1, 2, 3, 4] and got["key"] == [0, 0, -15, -5, 5, 5, 5]


def test_queries_cut_no_groups(spark, monkeypatch):
    """Both queries give their programs all groups of an item, far more than the twelve of before."""
    from contrasta.plans import choices as P

    def refused(*_, **__):
        raise AssertionError("groups are cut")

    monkeypatch.setattr(H, "bound_optional", refused)
    d = "/root/testdata/sf0.001"
    rows, found = P.stash(P.tiered(spark, d)), {r.item: r for r in P.choice_after(spark, d).collect()}
    assert rows.groupBy("item").count().where("count > 20").count() > 0
    assert len(found) == rows.select("item").distinct().count() and {r.status for r in found.values()} <= {"OPTIMAL", "INFEASIBLE", "MANDATORY_EXCEEDS_BUDGET"}
    before = H.select_before(rows, "hard", 2)
    after = {r.item: r for r in H.select_after(rows, before, 5, 1).collect()}
    assert all(found[i].chosen == ",".join(map(str, r.chosen)) for i, r in after.items() if r.chosen is not None)
