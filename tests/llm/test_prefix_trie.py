import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from contrasta.llm import prefix_trie as P
from contrasta.llm.shared import stash

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)

    def below(node):
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        for x in children[node]:
            more = below(x)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = set()
    for node in list(members):
        leaves, saved = below(node)
        out.add((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("name", "depth", "key", "words", "pos")})
    out = P.prefix_trie(*P.rebuilt(stash(P.ordered_turns(df)))).collect()
    got = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}
    assert len(got) == len(out)
    return got


def conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 200), n):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([None, t, t, t, 0]), r.choice(["user", "assistant", None]), r.choice([None, "", "hello", "a b  c", "\t x\n"])))
    return rows


def test_brute_force(spark):
    rows = conversations(0)
    assert found(spark, rows) == brute(rows)


def test_small_bounds(spark, monkeypatch):
    """Hot names by broadcast, stretches and runs of ids at tiny limits give the same nodes."""
    monkeypatch.setattr(P, "HOT_ROWS", 3)
    monkeypatch.setattr(P, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(P, "STRETCH", 4)
    monkeypatch.setattr(P, "IDS", 3)
    rows = conversations(1, 60) + [(500, t, "user", f"t{t % 3}") for t in range(70)] + [(501, t, "user", f"t{t % 3}") for t in range(66)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "a")]) == set()
    # 2 and 3 lose their only turn to a conversation that isn't there
    lost = [c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "gone") for c in lost]
    assert found(spark, rows) == brute(rows)
    rows = [(20, None, None, None), (20, None, None, None), (25, 3, "user", "word " * 200_000), (25, 3, "user", "word " * 200_000), (41, 1, "a", "b"), (None, None, "a", "b")]
    assert found(spark, rows) == brute(rows)
