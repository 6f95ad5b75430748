"""Choice evidence: which facts to show beside the four choices of a question.

universe() turns the facts of all choices into groups, one per family of keys and canonical node, and says for every choice that
lacks the group how it lacks it. Choices are bits, so one aggregation and one join serve all of them. select_before() and
select_after() pick groups by lexicographic 0-1 programs over all groups of an item, solved exactly by tables of states, many
items at once; an item whose states would be too many is searched by branch and bound, to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stash import looked_up

#: The letters of the choices, A being the answer; choice i is bit i.
LETTERS = "ABCD"
ANSWER, ALL = 1, (1 << len(LETTERS)) - 1
#: What an arm demands of an optional group, in the order in which reasons are given.
ARMS = ("penalty", "hard", "tolerate_unmodelled", "no_support_3_without_answer", "none_without_answer")

# -- the universe ----------------------------------------------------------------------------------------------------


def _bits(mask: Column) -> Column:
    return F.bit_count(mask)


def universe(edges: DataFrame, ancestors: DataFrame, modelled: DataFrame, hierarchical: Sequence[str] = ()) -> DataFrame:
    """(item, family, node, own, absent, contained, alternative, risk_present, risk_unmodelled, tier, verbal, soft, eligible): one row per group.

    edges: (item, letter, family, node, tier, verbal, soft, eligible), letter a place in LETTERS from 0 on. ancestors:
    (node, ancestor), transitive. modelled: (node) of the hierarchy. own: the choices with an edge to the node. Of the
    others, absent have nothing in the family; contained have a value below the node; alternative have other values,
    risk_present of them a value above the node, and risk_unmodelled ones in a family of `hierarchical` where the node or
    one of their values isn't in the hierarchy. A group is soft if one edge is, and eligible and verbal if all are.
    Repeated edges count once. Null families or nodes make no group.
    """
    bit = F.expr("shiftleft(1, letter)")
    edges = edges.where("family is not null and node is not null")
    known = modelled.select("node").distinct().withColumn("inside", F.lit(True))
    own = edges.groupBy("item", "family", "node").agg(F.bit_or(bit).alias("own"), F.min("tier").alias("tier"), F.min(F.col("verbal").cast("int")).alias("verbal"), F.max(F.col("soft").cast("int")).alias("soft"), F.min(F.col("eligible").cast("int")).alias("eligible"))
    lookup = ancestors.select("node", "ancestor").distinct().groupBy("node").agg(F.collect_set("ancestor").alias("ups"))
    lookup = looked_up(lookup.join(known, "node", "full"))
    own = own.join(lookup, "node", "left").select("item", "family", "node", "own", "tier", "verbal", "soft", "eligible", F.coalesce("ups", F.array().cast("array<string>")).alias("ups"), F.coalesce("inside", F.lit(False)).cast("int").alias("inside"))
    # each node is also offered to those above it: what arrives there from below is contained, and learns there what is above. Rows
    # stay with their item, so neither step is a join
    facts = ["own", "tier", "verbal", "soft", "eligible", "inside"]
    target = F.explode(F.concat(F.array(F.struct(F.col("node").alias("to"), F.lit(True).alias("self"))), F.transform("ups", lambda u: F.struct(u.alias("to"), F.lit(False).alias("self")))))
    sent = own.select("item", "family", "node", *facts, target.alias("t")).select("item", "family", F.col("t.to").alias("node"), "t.self", F.col("node").alias("child"), *facts)
    if_self = lambda c: F.max(F.when(F.col("self"), F.col(c))).alias(c)
    there = sent.groupBy("item", "family", "node").agg(*[if_self(c) for c in facts], F.bit_or(F.when(~F.col("self"), F.col("own"))).alias("below"), F.collect_list(F.when(~F.col("self"), F.col("child"))).alias("children")).where("own is not null")
    target = F.explode(F.concat(F.array(F.struct(F.col("node").alias("to"), F.lit(True).alias("self"))), F.transform("children", lambda u: F.struct(u.alias("to"), F.lit(False).alias("self")))))
    sent = there.select("item", "family", *facts, "below", target.alias("t")).select("item", "family", F.col("t.to").alias("node"), "t.self", *facts, "below")
    groups = sent.groupBy("item", "family", "node").agg(*[if_self(c) for c in [*facts, "below"]], F.bit_or(F.when(~F.col("self"), F.col("own"))).alias("above"))
    family = Window.partitionBy("item", "family")
    groups = groups.withColumns({"has": F.bit_or("own").over(family), "odd": F.bit_or(F.when(F.col("inside") == 1, F.lit(0)).otherwise(F.col("own"))).over(family), "inside": F.col("inside") == 1, "below": F.coalesce("below", F.lit(0)), "above": F.coalesce("above", F.lit(0))})
    groups = groups.withColumns({"absent": F.expr(f"{ALL} & ~has"), "contained": F.expr("below & ~own")})
    groups = groups.withColumn("alternative", F.expr(f"{ALL} & ~own & ~absent & ~contained"))
    groups = groups.withColumn("risk_present", F.expr("alternative & above"))
    modelled_family = F.col("family").isin(*hierarchical) if hierarchical else F.lit(False)
    odd = F.when(modelled_family & ~F.col("inside"), F.expr("alternative & ~above")).when(modelled_family, F.expr("alternative & ~above & odd")).otherwise(F.lit(0))
    return groups.select("item", "family", "node", "own", "absent", "contained", "alternative", "risk_present", odd.alias("risk_unmodelled"), "tier", F.col("verbal") == 1, F.col("soft") == 1, F.col("eligible") == 1).toDF(
        "item", "family", "node", "own", "absent", "contained", "alternative", "risk_present", "risk_unmodelled", "tier", "verbal", "soft", "eligible"
    )


def tiers(groups: DataFrame, rationale: DataFrame) -> DataFrame:
    """`groups` with role, alt_for and place.

    rationale: (item, family, node, covers), the facts of the answer's rationale and the choices that each tells from it.
    Its groups are MANDATORY; ineligible ones EXCLUDED; ALTERNATIVE those in a family of the rationale that a choice
    owns which the rationale tells from the answer by that family (alt_for); the others OPTIONAL. place: 0, 1, .. in the
    canonical order of the item's groups.
    """
    # an item's rationale is a few facts: one row of them, so that groups move once, by item
    told = rationale.groupBy("item").agg(F.collect_list(F.struct("family", "node", "covers")).alias("told"))
    rows = groups.join(told.hint("merge"), "item", "left").withColumn("told", F.filter(F.coalesce("told", F.array().cast(told.schema["told"].dataType)), lambda x: x.family == F.col("family")))
    rows = rows.withColumns({"mandatory": F.exists("told", lambda x: x.node == F.col("node")), "told": F.aggregate("told", F.lit(0).cast(told.schema["told"].dataType.elementType["covers"].dataType), lambda s, x: s.bitwiseOR(x.covers))})
    rows = rows.withColumn("alt_for", F.expr(f"own & told & ~{ANSWER}"))
    role = F.when(F.col("mandatory"), "MANDATORY").when(~F.col("eligible"), "EXCLUDED").when(F.col("alt_for") > 0, "ALTERNATIVE").otherwise("OPTIONAL")
    rows = rows.withColumn("role", role).drop("mandatory", "told")
    rank = F.when(F.col("role") == "MANDATORY", 0).when(F.col("role") == "ALTERNATIVE", 1).when(F.col("role") == "OPTIONAL", 2).otherwise(3)
    order = Window.partitionBy("item").orderBy(rank, F.desc(_bits(F.col("own"))), "tier", F.desc("verbal"), _bits(F.col("absent")), F.col("own") == ANSWER, _bits(F.col("own")) == 1, tokens(F.col("node")), F.char_length("node"), "family", "node")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def tokens(node: Column) -> Column:
    """Words of letters and digits in a node's name."""
    return F.size(F.filter(F.split(node, "[^A-Za-z0-9]+"), lambda w: w != ""))


def risky(groups_prefix: str = "") -> Column:
    return F.expr("risk_present | risk_unmodelled") > 0


def failed(arm: str) -> Column:
    """The reasons for which an arm refuses an optional group, all of them, in their order."""
    if arm not in ARMS:
        raise ValueError(f"{arm!r} isn't one of {ARMS}")
    support = _bits(F.col("own"))
    rules = [(~F.col("verbal"), "UNVERBALIZABLE"), (F.col("own") == ANSWER, "ANSWER_ONLY")]
    if arm != "penalty":
        rules += [(support < 2, "SUPPORT_BELOW_2"), (F.col("absent") > 0, "ABSENCE_ONLY"), (F.col("contained") > 0, "CONTAINED"), (F.col("risk_present") > 0, "RISK_PRESENT")]
        if arm != "tolerate_unmodelled":
            rules.append((F.col("risk_unmodelled") > 0, "RISK_UNMODELLED"))
        without = F.expr(f"own & {ANSWER}") == 0
        if arm == "no_support_3_without_answer":
            rules.append((without & (support == 3), "SUPPORT_3_WITHOUT_ANSWER"))
        if arm == "none_without_answer":
            rules.append((without, "WITHOUT_ANSWER"))
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())


def bound_optional(groups: DataFrame, most: int | None, per_family: int | None = None, per_letter: int | None = None) -> DataFrame:
    """`groups` without optional ones beyond `most` per item, by support, tier, words, length and name.

    With per_family or per_letter, strata stay whatever `most` is: groups of a node that a mandatory or alternative
    group has, the first of each family, the first of each letter but the answer's. Other roles are never cut. No query
    calls it: the selections take all groups.
    """
    if most is None:
        return groups
    optional = F.col("role") == "OPTIONAL"
    key = [F.desc(_bits(F.col("own"))), "tier", F.desc("verbal"), "words", F.char_length("node"), "family", "node"]
    at = lambda *by: F.row_number().over(Window.partitionBy("item", "role", *by).orderBy(*key))
    rows = groups.withColumn("words", tokens(F.col("node"))).withColumn("turn", at())
    keep = ~optional | (F.col("turn") <= most)
    if per_family or per_letter:
        fixed = F.max(F.col("role").isin("MANDATORY", "ALTERNATIVE")).over(Window.partitionBy("item", "node"))
        strata = fixed
        if per_family:
            strata = strata | (at("family") <= per_family)
        for i in range(1, len(LETTERS) if per_letter else 0):
            has = F.col("own").bitwiseAND(F.lit(1 << i)) > 0
            strata = strata | has & (at(has) <= per_letter)
        rows = rows.withColumn("stratum", strata)
        rest = F.sum(F.when(optional & ~F.col("stratum"), 1).otherwise(0)).over(Window.partitionBy("item").orderBy("role", "turn").rowsBetween(Window.unboundedPreceding, 0))
        held = F.sum(F.when(optional & F.col("stratum"), 1).otherwise(0)).over(Window.partitionBy("item"))
        keep = ~optional | F.col("stratum") | (rest + held <= most)
    return rows.withColumn("keep", keep).where("keep").drop("turn", "keep", "stratum", "words")


# -- exact selection -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Group:
    place: int
    family: int
    node: int
    own: int
    support: int
    absent: int
    risk: int
    tier: int
    words: int
    alt: int = 0
    answer_only: bool = False
    fixed: bool = False


@dataclass(frozen=True)
class Given:
    """What mandatory groups bring along."""

    letters: int
    families: frozenset
    nodes: frozenset


def before_key(given: Given, chosen: Sequence[Group]) -> tuple[int, ...]:
    """Uncovered letters, less shared information, fewer families, more groups, tiers, words: each is to be small."""
    letters = given.letters
    for g in chosen:
        letters |= g.own
    return (len(LETTERS) - letters.bit_count(), -sum(g.support - 1 for g in chosen), -len({g.family for g in chosen} - given.families), len(chosen), sum(g.tier for g in chosen), sum(g.words for g in chosen))


def after_key(given: Given, chosen: Sequence[Group]) -> tuple[int, ...]:
    """Absences, risky groups, less shared information, fewer families, more nodes, tiers, words."""
    return (sum(g.absent for g in chosen), sum(g.risk for g in chosen), -sum(g.support - 1 for g in chosen), -len({g.family for g in chosen} - given.families), len({g.node for g in chosen} - given.nodes), sum(g.tier for g in chosen), sum(g.words for g in chosen))


class Search:
    """Depth first over groups in canonical order, taking before leaving, so that of equal keys the canonical one is met first.

    A branch is left if no completion can have a smaller key than the best so far. `floors` gives keys such that every
    completion's key is at least one of them in each component, and thus in the lexicographic order too.
    """

    def __init__(self, groups: Sequence[Group], key: Callable, floors: Callable, allowed: Callable, complete: Callable, order: Sequence[int], most_nodes: int | None) -> None:
        self.groups, self.key, self.floors, self.allowed, self.complete = groups, key, floors, allowed, complete
        self.order, self.most_nodes = order, most_nodes
        self.best: tuple | None = None
        self.chosen: list[Group] | None = None
        self.nodes = 0

    def permuted(self, key: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(key[i] for i in self.order)

    def run(self) -> str:
        stack: list[tuple[int, list[Group]]] = [(0, [])]
        while stack:
            i, chosen = stack.pop()
            self.nodes += 1
            if self.most_nodes is not None and self.nodes > self.most_nodes:
                return "LIMIT"
            if self.best is not None and min(self.permuted(f) for f in self.floors(i, chosen)) >= self.best:
                continue
            if i == len(self.groups):
                if self.complete(chosen):
                    self.best, self.chosen = self.permuted(self.key(chosen)), chosen
                continue
            g = self.groups[i]
            if not g.fixed:
                stack.append((i + 1, chosen))
            if self.allowed(chosen, g):
                stack.append((i + 1, [*chosen, g]))
        return "OPTIMAL" if self.chosen is not None else "INFEASIBLE"


def solve_before(groups: Sequence[Group], given: Given, budget: int, order: Sequence[int], most_nodes: int | None) -> tuple[str, list[Group] | None, int]:
    """At most `budget` groups of least before_key(), its components in `order`."""
    n = len(groups)
    reach, families = [0] * (n + 1), [frozenset()] * (n + 1)
    least: list[tuple[list[int], list[int], list[int]]] = [([0], [0], [0])] * (n + 1)
    for i in range(n - 1, -1, -1):
        reach[i] = reach[i + 1] | groups[i].own
        families[i] = families[i + 1] | {groups[i].family}
    for i in range(n):
        rest = groups[i:]
        sums = lambda xs: [sum(xs[:j]) for j in range(min(budget, len(xs)) + 1)]
        least[i] = sums(sorted((1 - g.support for g in rest))), sums(sorted(g.tier for g in rest)), sums(sorted(g.words for g in rest))

    def floors(i: int, chosen: list[Group]) -> Iterator[tuple[int, ...]]:
        u, info, fam, count, tier, words = before_key(given, chosen)
        covered = given.letters
        for g in chosen:
            covered |= g.own
        missing = len(LETTERS) - (covered | reach[i]).bit_count()
        new = len(families[i] - given.families - {g.family for g in chosen})
        for j in range(min(budget - count, n - i) + 1):  # exactly j more groups
            yield (missing if j else u, info + least[i][0][j], fam - min(j, new), count + j, tier + least[i][1][j], words + least[i][2][j])

    search = Search(groups, lambda c: before_key(given, c), floors, lambda c, g: len(c) < budget, lambda c: True, order, most_nodes)
    return search.run(), search.chosen, search.nodes


def solve_after(groups: Sequence[Group], given: Given, budget: int, answer_only: int, order: Sequence[int], most_nodes: int | None) -> tuple[str, list[Group] | None, int]:
    """Groups of least after_key() on at most `budget` nodes, mandatory ones counted, with an alternative for every letter that has one and at most `answer_only` groups of the answer alone."""
    if len(given.nodes) > budget:
        return "MANDATORY_EXCEEDS_BUDGET", None, 0
    wanted = 0
    for g in groups:
        wanted |= g.alt
    n = len(groups)
    suffix = [frozenset(g.family for g in groups[i:]) for i in range(n + 1)]

    def paid(chosen: Sequence[Group]) -> set[int]:
        return {g.node for g in chosen} | given.nodes

    def allowed(chosen: list[Group], g: Group) -> bool:
        nodes = paid(chosen)
        return (g.node in nodes or len(nodes) < budget) and (not g.answer_only or g.fixed or sum(x.answer_only for x in chosen) < answer_only)

    def complete(chosen: list[Group]) -> bool:
        have = 0
        for g in chosen:
            have |= g.alt
        return have == wanted and sum(g.answer_only for g in chosen) <= answer_only

    def floors(i: int, chosen: list[Group]) -> Iterator[tuple[int, ...]]:
        absent, risk, info, fam, nodes, tier, words = after_key(given, chosen)
        have, there = 0, paid(chosen)
        for g in chosen:
            have |= g.alt
        rest, missing = groups[i:], wanted & ~have
        for bit in (1 << b for b in range(len(LETTERS))):
            if missing & bit:  # one of the remaining alternatives has to come
                alts = [g for g in rest if g.alt & bit]
                if not alts:
                    return
                absent, risk = max(absent, after_key(given, chosen)[0] + min(g.absent for g in alts)), max(risk, after_key(given, chosen)[1] + min(g.risk for g in alts))
        free, per_node = 0, {}
        for g in rest:
            if g.node in there:
                free += g.support - 1
            else:
                per_node[g.node] = per_node.get(g.node, 0) + g.support - 1
        values = sorted(per_node.values(), reverse=True)
        new = len(suffix[i] - given.families - {g.family for g in chosen})
        for j in range(min(budget - len(there), len(values)) + 1):  # exactly j more nodes
            yield (absent, risk, info - free - sum(values[:j]), fam - new, nodes + j, tier, words)

    def no_floor(i: int, chosen: list[Group]) -> Sequence[tuple[int, ...]]:
        return list(floors(i, chosen)) or [(1 << 60,) * 7]

    search = Search(groups, lambda c: after_key(given, c), no_floor, allowed, complete, order, most_nodes)
    return search.run(), search.chosen, search.nodes


# -- the same programs, many items at once ----------------------------------------------------------------------------

#: States that are held at once, of all items that are solved together.
STATES = 1 << 19
#: Nodes with groups in several families that states tell apart; an item with more of them is searched.
SHARED = 6


@dataclass(frozen=True)
class Program:
    """What is to be small, in `order`: the sums of `costs`, new families (at `family`) and what is spent (at `spent`), and letters not covered (at `letter`; None: all must be)."""

    costs: Sequence[str | None]
    family: int
    spent: int
    letter: int | None
    budget: int
    lone: int
    order: Sequence[int]


BEFORE = ((None, "info", None, None, "tier", "words"), 2, 3, 0)
AFTER = (("absent", "risk", "info", None, None, "tier", "words"), 3, 4, None)


@lru_cache(maxsize=32)
def _moves(budget: int, lone: int, shared: int) -> tuple[np.ndarray, ...]:
    """The states of a search and where each leads: (states, take, leave, unpaid).

    states: shared nodes paid, what may be spent, letters not covered, whether the family has a group, groups of the answer alone that
    may come. take: by what a group needs (0 nothing, 1 one, 2 + i shared node i), its letters, whether it is the answer's alone and the
    last of its family; the number after the last state is the dead end. leave: by whether it is the last. unpaid: where a need costs one.
    """
    shape = (1 << shared, budget + 1, ALL + 1, 2, lone + 1)
    states = np.indices(shape).reshape(5, -1)
    paid, left, missing, has, more = states
    unpaid = np.array([np.zeros_like(paid), np.ones_like(paid), *[1 - (paid >> i & 1) for i in range(shared)]])
    take = np.empty((2 + shared, ALL + 1, 2, 2, len(paid)), dtype=np.int64)
    for need, letters, alone, last in np.ndindex(take.shape[:4]):
        then = (paid | (1 << (need - 2)) if need > 1 else paid), left - unpaid[need], missing & ~letters, np.full_like(has, 1 - last), more - alone
        take[need, letters, alone, last] = np.where((then[1] >= 0) & (then[4] >= 0), np.ravel_multi_index(then, shape, mode="clip"), len(paid))
    leave = np.array([np.ravel_multi_index((paid, left, missing, has * (1 - last), more), shape) for last in (0, 1)])
    return states, take.reshape(-1, len(paid)), leave, unpaid


def tabulated(p: Program, item: np.ndarray, rows: dict[str, np.ndarray], start: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(solved, taken, states): which items have a solution, which rows are in the best one, and how many states each item had.

    rows: groups by item and place, families and nodes as numbers: place order breaks ties as Search does. start: of each item what may be
    spent, the letters to cover and its shared nodes. Families are gone through one after the other, from the end: a state's
    best rest is known before the states that lead to it, so all states are met and no order of groups is slow.
    """
    n = len(start["budget"])
    size = np.bincount(item, minlength=n)
    pos = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size)
    # one number in place of the components: each outweighs all that come after it
    most = [max(np.bincount(item, weights=np.abs(rows[c]), minlength=n).max(initial=0), 0) if c else max(size.max(initial=0), len(LETTERS)) for c in p.costs]
    weight, top = [0] * len(most), 1
    for c in reversed(p.order):
        weight[c], top = top, top * (int(most[c]) + 1)
    kind = np.int64 if top < 1 << 59 else object
    cost = np.zeros(len(item), dtype=kind)
    for c, w in zip(p.costs, weight, strict=True):
        if c:
            cost = cost + rows[c].astype(kind) * w
    marks = np.int64 if size.max(initial=0) < 62 else object
    mark = np.array([1], dtype=marks) << (np.repeat(size, size) - 1 - pos).astype(marks)
    by = np.lexsort((pos, rows["family"], item))
    family, owner = rows["family"][by], item[by]
    last = np.append((family[1:] != family[:-1]) | (owner[1:] != owner[:-1]), True)[: len(by)]
    solved, taken, states = np.zeros(n, dtype=bool), np.zeros(len(item), dtype=bool), np.zeros(n, dtype=np.int64)
    best = np.zeros(n, dtype=marks)
    for shared in np.unique(start["shared"]):
        (all_states, take, leave, unpaid), dead = _moves(p.budget, p.lone, int(shared)), 4 * top
        count = all_states.shape[1]
        end = np.bitwise_count(all_states[2]).astype(kind) * weight[p.letter] if p.letter is not None else np.where(all_states[2] > 0, dead, 0).astype(kind)
        first = (all_states[3] == 0).astype(kind)
        some = np.flatnonzero(start["shared"] == shared)
        some = some[np.argsort(-size[some], kind="stable")]
        states[some] = count * (size[some] + 1)
        many = max(1, STATES // count)
        for chunk in (some[i : i + many] for i in range(0, len(some), many)):
            turn = np.full(n, -1)
            turn[chunk] = np.arange(len(chunk))
            mine = turn[owner] >= 0
            r = by[mine]
            at = turn[item[r]], pos[mine]
            grid = lambda x, t: _grid(at, x, (len(chunk), size[chunk[0]]), t)  # noqa: E731, B023
            lasts = last[mine].astype(np.int64)
            need = grid(rows["need"][r], np.int64)
            move = grid(np.ravel_multi_index((rows["need"][r], rows["letters"][r], rows["lone"][r], lasts), (2 + int(shared), ALL + 1, 2, 2)), np.int64)
            lasts, fixed, costs, new, bits = grid(lasts, np.int64), grid(rows["fixed"][r], bool), grid(cost[r], kind), grid(rows["new"][r], bool), grid(mark[r], marks)
            value = np.concatenate([np.tile(end, (len(chunk), 1)), np.full((len(chunk), 1), dead, dtype=kind)], axis=1)
            held = np.zeros(value.shape, dtype=marks)
            for k in range(size[chunk[0]] - 1, -1, -1):
                a = int(np.searchsorted(-size[chunk], -k))  # items with a group k: the first ones
                base = np.arange(a)[:, None] * (count + 1)
                to, off = take[move[:a, k]] + base, leave[lasts[:a, k]] + base
                yes = value.ravel()[to] + costs[:a, k, None] - np.where(new[:a, k, None], first * weight[p.family], 0) + unpaid[need[:a, k]] * weight[p.spent]
                no = np.where(fixed[:a, k, None], dead, value.ravel()[off])
                with_, without = held.ravel()[to] + bits[:a, k, None], held.ravel()[off]
                better = (yes < no) | ((yes == no) & (with_ > without))
                value[:a, :count], held[:a, :count] = np.where(better, yes, no), np.where(better, with_, without)
            from_ = np.ravel_multi_index((np.zeros(len(chunk), dtype=np.int64), start["budget"][chunk], start["letters"][chunk], np.zeros(len(chunk), dtype=np.int64), np.full(len(chunk), p.lone)), (1 << int(shared), p.budget + 1, ALL + 1, 2, p.lone + 1))
            solved[chunk] = value[np.arange(len(chunk)), from_] < 2 * top
            best[chunk] = held[np.arange(len(chunk)), from_]
    taken = ((np.repeat(best, size) & mark) > 0) & np.repeat(solved, size)
    return solved, taken.astype(bool), states


def _grid(at: tuple[np.ndarray, np.ndarray], x: np.ndarray, shape: tuple[int, int], kind: type) -> np.ndarray:
    out = np.zeros(shape, dtype=kind)
    out[at] = x
    return out


RESULT = "status string, chosen array<int>, key array<int>, nodes_searched long"


def _numbered(item: np.ndarray, mine: pa.Array, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Names as numbers of item and name, and whether the item's list has them."""
    both = pa.concat_arrays([mine, lists.flatten().cast(mine.type)]).dictionary_encode()
    owners = np.concatenate([item, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())])
    number = owners * (len(both.dictionary) + 1) + both.indices.to_numpy(zero_copy_only=False)
    return number[: len(item)], np.isin(number[: len(item)], number[len(item) :])


def _solve(batch: pa.RecordBatch, p: Program) -> pa.RecordBatch:
    after, n = p.letter is None, len(batch)
    lists = batch.column("groups")
    item, flat = np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten()
    get = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = {c: get(c) for c in ("place", "own", "absent", "risk", "tier", "words", "alt", "lone", "fixed")}
    rows["family"], known = _numbered(item, flat.field("family"), batch.column("families"))
    node, free = _numbered(item, flat.field("node"), batch.column("nodes"))
    rows["new"], rows["info"] = ~known, 1 - np.bitwise_count(rows["own"]).astype(np.int64)
    spent, status = batch.column("nodes").value_lengths().to_numpy() if after else np.zeros(n, dtype=np.int64), np.full(n, "INFEASIBLE", dtype=object)
    rows["letters"], shared = (rows["alt"] if after else rows["own"]), np.zeros(n, dtype=np.int64)
    rows["need"] = np.ones(len(item), dtype=np.int64)
    if after:
        names, at, times = np.unique(node, return_inverse=True, return_counts=True)
        several = (times[at] > 1) & ~free
        twice, place = np.unique(node[several], return_inverse=True)
        owner = np.zeros(len(twice), dtype=np.int64)
        owner[place] = item[several]
        shared = np.bincount(owner, minlength=n)
        before = np.cumsum(shared) - shared
        rows["need"][several] = 2 + place - before[item[several]]
        rows["need"][free] = 0
    else:
        rows["lone"] = np.zeros(len(item), dtype=np.int64)
    goal = np.zeros(n, dtype=np.int64)
    if after:
        np.bitwise_or.at(goal, item, rows["alt"])
    else:
        goal = ALL & ~batch.column("letters").to_numpy(zero_copy_only=False).astype(np.int64)
    status[spent > p.budget] = "MANDATORY_EXCEEDS_BUDGET"
    small = (spent <= p.budget) & (shared <= SHARED)
    number, part = np.cumsum(small) - 1, small[item]
    solved, taken, states = tabulated(p, number[item[part]], {c: x[part] for c, x in rows.items()}, {"budget": (p.budget - spent)[small], "letters": goal[small], "shared": shared[small]})
    chosen, searched = np.zeros(len(item), dtype=bool), np.zeros(n, dtype=np.int64)
    chosen[part], searched[small] = taken, states
    status[np.flatnonzero(small)[solved]] = "OPTIMAL"
    for i in np.flatnonzero((spent <= p.budget) & ~small):
        mine = np.flatnonzero(item == i)
        given = Given(0, frozenset(rows["family"][mine][known[mine]].tolist()), frozenset([*node[mine][free[mine]].tolist(), *[-1 - k for k in range(spent[i] - len(set(node[mine][free[mine]].tolist())))]]))
        some = [Group(int(k), int(rows["family"][k]), int(node[k]), int(rows["own"][k]), int(rows["own"][k]).bit_count(), *[int(rows[c][k]) for c in ("absent", "risk", "tier", "words", "alt")], bool(rows["lone"][k]), bool(rows["fixed"][k])) for k in mine]
        status[i], found, searched[i] = solve_after(some, given, p.budget, p.lone, p.order, None)
        chosen[[g.place for g in found or []]] = True
    own = item[chosen]
    total = lambda x: np.bincount(own, weights=x, minlength=n).astype(np.int64)
    distinct = lambda x, which: np.bincount(item[chosen][which][np.unique(x[chosen][which], return_index=True)[1]], minlength=n)
    key = [total(rows[c][chosen]) if c else None for c in p.costs]
    key[p.family] = -distinct(rows["family"], ~known[chosen])
    key[p.spent] = distinct(node, ~free[chosen]) if after else total(np.ones(len(own)))
    if not after:
        letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(np.int64)
        np.bitwise_or.at(letters, own, rows["own"][chosen])
        key[p.letter] = len(LETTERS) - np.bitwise_count(letters).astype(np.int64)
    done = status == "OPTIMAL"
    places = np.split(rows["place"][chosen], np.cumsum(np.bincount(own, minlength=n))[:-1])
    keys = np.stack(key, axis=1)
    return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(status, pa.string()), pa.array([x if d else None for x, d in zip(places, done, strict=True)], pa.list_(pa.int32())), pa.array([x if d else None for x, d in zip(keys, done, strict=True)], pa.list_(pa.int32())), pa.array(searched, pa.int64())], names=["item", "status", "chosen", "key", "nodes_searched"])


def _in_batches(groups: DataFrame, wanted: Column, p: Program) -> DataFrame:
    """One row per item, of RESULT: its mandatory groups summed up, its `wanted` ones an array, and whole batches of items to a task's Python."""
    rows = groups.select("item", "place", "family", "node", "own", "absent", "risk_present", "risk_unmodelled", "tier", tokens(F.col("node")).alias("words"), "alt_for", "role", "fixed", wanted.alias("wanted"))
    given = F.col("role") == "MANDATORY"
    one = F.struct("place", "family", "node", "own", _bits(F.col("absent")).alias("absent"), risky().cast("int").alias("risk"), "tier", "words", F.when(F.col("role") == "ALTERNATIVE", F.col("alt_for")).otherwise(F.lit(0)).alias("alt"), ((F.col("role") == "OPTIONAL") & (F.col("own") == ANSWER)).alias("lone"), "fixed")
    rows = rows.groupBy("item").agg(F.coalesce(F.bit_or(F.when(given, F.col("own"))), F.lit(0)).alias("letters"), F.collect_set(F.when(given, F.col("family"))).alias("families"), F.collect_set(F.when(given, F.col("node"))).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("wanted"), one))).alias("groups"))
    schema = f"item {dict(groups.dtypes)['item']}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _solve(batch, p)

    return rows.mapInArrow(run, schema)


def select_before(groups: DataFrame, arm: str, budget: int, order: Sequence[int] = tuple(range(6))) -> DataFrame:
    """(item, status, chosen, key, nodes_searched): what to show before the answer, as places of tiers().

    Optional groups that `arm` admits, at most `budget`, of least before_key(). status: OPTIMAL. Every item of `groups` has a row.
    """
    wanted = (F.col("role") == "OPTIONAL") & (F.size(failed(arm)) == 0)
    return _in_batches(groups.withColumn("fixed", F.lit(False)), wanted, Program(*BEFORE, budget, 0, tuple(order)))


def select_after(groups: DataFrame, before: DataFrame, budget: int, answer_only: int, order: Sequence[int] = tuple(range(7))) -> DataFrame:
    """(item, status, chosen, key, nodes_searched): what to show after the answer: all of `before`, and more.

    Optional and alternative groups of least after_key(), on at most `budget` nodes with the mandatory ones. status: OPTIMAL,
    INFEASIBLE or MANDATORY_EXCEEDS_BUDGET; only the first has a choice. Items without a choice in `before` have nothing fixed.
    """
    fixed = before.select("item", "chosen").hint("merge")
    rows = groups.join(fixed, "item", "left").withColumn("fixed", F.coalesce(F.array_contains("chosen", F.col("place").cast("int")), F.lit(False)))
    return _in_batches(rows, F.col("role").isin("OPTIONAL", "ALTERNATIVE"), Program(*AFTER, budget, answer_only, tuple(order)))
