"""The trie of all conversation prefixes, by prefix doubling.

Turns get dense names. Two neighbouring blocks of 2^(k-1) turns make one of 2^k, named by the pair of their names, so all
aligned blocks are named in as many rounds as the longest conversation's length has bits. The prefix of d turns is a chain
of such blocks, one for every bit of d, longest first; its name comes from the name of the chain without its last block and
that block. Equal names are equal prefixes, so grouping by name gives the nodes. A node's subtree is summed without walking
the tree: each node belongs to its smallest member, the nodes of a member are the end of its path, so sums from the end of
each path, added up over the members of a node, count every node below it once.

Work is keyed by conversation and place, never by conversation alone; names that many rows share are looked up by a
broadcast whose size is bounded by a rule (see lookup()).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import arrow_rows, stash, table

BLANKS = r"[\x20\x09-\x0D]+"
#: A key that more rows than this share, and more than a hundred-thousandth of all, is looked up by broadcast: at most 100,000 keys at any size.
HOT_ROWS, HOT_KEYS = 10_000, 100_000
#: Turns of one conversation that a window holds at once.
STRETCH = 1024
#: Ids that a row holds on the way to a digest.
IDS = 4096
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def lookup(left: DataFrame, right: DataFrame, on: list[str], total: int) -> DataFrame:
    """`left` with what `right`, one row per key, says of its keys; `right` has in `rows` how many of the `total` rows of `left` each key has.

    Keys with many rows are joined where their rows lie, so no task gets all rows of one key.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    many = right.where(F.col("rows") > most).drop("rows")
    few = right.where(F.col("rows") <= most).drop("rows")
    if total <= HOT_ROWS or many.isEmpty():
        return left.join(few, on, "left")
    rest = left.join(F.broadcast(many.select(*on)), on, "left_anti")
    return left.join(F.broadcast(many), on).unionByName(rest.join(few, on, "left"))


def _by_partition(spark, rows: list[tuple], columns: str) -> DataFrame:
    """A small table, one row per partition of another one."""
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns.split())))


def numbered(df: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """`df` written, with a dense `name` from `first` on, and the next free name. The driver sees one count per partition."""
    written = stash(df.withColumn("at", F.monotonically_increasing_id()))
    pid = F.shiftright("at", 33)
    starts, at = [], first
    for r in sorted(written.groupBy(pid.alias("pid")).count().collect()):
        starts.append((r.pid, at))
        at += r["count"]
    out = written.withColumn("pid", pid).join(_by_partition(df.sparkSession, starts, "pid start"), "pid")
    return out.withColumn("name", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("pid", "at", "start"), at


# -- turns in order --------------------------------------------------------------------------------------------------


def _count_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation in a sorted partition from 0 on."""
    import numpy as np

    pid, last, last_n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        ids = b.column(0).to_numpy()
        n = len(ids)
        if not n:
            continue
        begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        local = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        if last is not None and ids[0] == last:
            local[: begins[1] if len(begins) > 1 else n] += last_n
        last, last_n = ids[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.full(n, pid, np.int64)), pa.array(local.astype(np.int64))], names=["conv_id", "key", "words", "pid", "local"])


def turn_key(role: Column, text: Column) -> Column:
    """Equal for equal roles and texts only: a SHA-256."""
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): every turn with its place in its conversation, from 0 on.

    Turns are in the order of `turn`, nulls first; turns that tie are in the order of their key, and repeated rows are
    repeated turns. Null roles and texts count as empty. Rows without a conv_id are no conversation's and are left out.
    words: words of the text. Other columns are not read. An empty table gives an empty result. Texts of any length
    are read whole, and only their digests move; rows are ranged by conversation and turn, so that a long conversation
    is spread over several tasks.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 10_000)
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    words = F.size(F.filter(F.split(said, BLANKS), lambda w: w != "")).cast("long")
    short = rows.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_key(by, said).alias("key"), words.alias("words"))
    short = stash(short.withColumn("tie", F.monotonically_increasing_id()))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("tie")]
    dealt = short.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.unhex("key").alias("key"), "words")
    counted = stash(dealt.mapInArrow(_count_along, "conv_id bigint, key binary, words bigint, pid bigint, local bigint"))
    # a conversation that goes on from one range into the next: the driver sees one row per range
    ranges = counted.groupBy("pid").agg(F.min("conv_id").alias("begins"), F.max(F.struct("conv_id", "local")).alias("ends")).collect()
    starts, last, so_far = [], None, 0
    for r in sorted(ranges, key=lambda r: r.pid):
        goes_on = so_far if r.begins == last else 0
        starts.append((r.pid, r.begins, goes_on))
        so_far = r.ends.local + 1 + (goes_on if r.ends.conv_id == r.begins else 0)
        last = r.ends.conv_id
    starts = _by_partition(spark, starts, "pid begins start")
    pos = F.col("local") + F.when(F.col("conv_id") == F.col("begins"), F.col("start")).otherwise(F.lit(0))
    return counted.join(starts, "pid").select("conv_id", pos.alias("pos"), "key", "words")


# -- the trie --------------------------------------------------------------------------------------------------------


def _named_blocks(turns: DataFrame, total: int, longest: int) -> list[DataFrame]:
    """By k: (conv_id, j, name) of the block of turns j * 2^k up to (j + 1) * 2^k."""
    names, _ = numbered(turns.groupBy("key").agg(F.count("*").alias("rows")))
    blocks = [stash(lookup(turns.select("conv_id", F.col("pos").alias("j"), "key"), names, ["key"], total).select("conv_id", "j", "name"))]
    for _ in range(longest.bit_length() - 1):
        half = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name"))).alias("ab"[odd])
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(half(0), half(1)).where("b is not null")
        pairs = stash(pairs)
        names, _ = numbered(pairs.groupBy("a", "b").agg(F.count("*").alias("rows")))
        blocks.append(stash(lookup(pairs, names, ["a", "b"], pairs.count()).select("conv_id", "j", "name")))
    return blocks


def _named_prefixes(blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name) of every prefix of at least one turn; the root's name would be 0."""
    rounds, free = [], 1
    for k in range(len(blocks) - 1, -1, -1):
        ends = blocks[k].where("j % 2 = 0").select("conv_id", F.shiftleft("j", k).alias("depth"), F.col("name").alias("b"))
        if rounds:
            known = reduce(DataFrame.unionByName, rounds)
            known = known.where(F.col("depth") % (2 << k) == 0).withColumnRenamed("name", "a")
            chain = ends.where("depth > 0").join(known, ["conv_id", "depth"]).unionByName(ends.where("depth = 0").withColumn("a", F.lit(0).cast("long")))
        else:
            chain = ends.where("depth = 0").withColumn("a", F.lit(0).cast("long"))
        chain = stash(chain)
        names, free = numbered(chain.groupBy("depth", "a", "b").agg(F.count("*").alias("rows")), free)
        found = lookup(chain, names, ["depth", "a", "b"], chain.count())
        rounds.append(stash(found.select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), "name")))
    return reduce(DataFrame.unionByName, rounds)


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node.

    convs: conv_id of every conversation, once, also of those without turns. turns: (conv_id, pos, key, words), places
    from 0 on without gaps. A node is a distinct sequence of the first `depth` turns; its members are the conversations
    that begin with it, conv_id the smallest of them; parent_conv_id is null for the root alone. n_leaves counts the
    childless nodes of the node's subtree, saved_tokens adds (n_convs - 1) * words of the last turn over it, top
    included; ends_sha256 digests the ids of members without further turns, ascending, with commas. Without
    conversations there are no nodes.
    """
    turns = stash(turns)
    lengths = stash(turns.groupBy("conv_id").agg(F.count("*").alias("length")))
    total, longest = turns.count(), lengths.agg(F.max("length")).first()[0] or 0
    none = F.lit(0).cast("long")
    at_root = convs.join(lengths, "conv_id", "left_anti").select(none.alias("name"), "conv_id")
    everyone = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    everyone = everyone.withColumns({"name": none, "depth": none, "parent_conv_id": F.lit(None).cast("long")})
    if not total:
        alone = everyone.withColumns({"n_children": none, "n_leaves": none + 1, "saved_tokens": none})
        return _shown(alone.join(_digests(at_root), "name", "left"))
    prefixes = stash(_named_prefixes(_named_blocks(turns, total, longest)))
    nodes = stash(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs")))
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    nodes = stash(nodes.join(last, ["conv_id", "depth"]).join(above, ["conv_id", "depth"], "left").withColumn("parent", F.coalesce("parent", none)))
    children = stash(nodes.groupBy("parent").agg(F.count("*").alias("n_children")))
    nodes = stash(nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("value"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    parents = nodes.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    smallest, first_turns = everyone.first().conv_id, nodes.where("parent = 0").count()
    inner = lookup(nodes.where("parent > 0"), parents, ["parent"], nodes.count())
    outer = nodes.where("parent = 0").withColumn("parent_conv_id", F.lit(smallest).cast("long"))
    sums = subtree_sums(prefixes, owned)
    ends = prefixes.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("name", "conv_id").unionByName(at_root)
    below = owned.agg(F.sum("value").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    top = everyone.join(F.broadcast(below.withColumn("name", none)), "name").withColumn("n_children", F.lit(first_turns))
    named = inner.unionByName(outer).join(sums, "name")
    return _shown(named.select("name", *NODE).unionByName(top.select("name", *NODE)).join(_digests(ends), "name", "left"))


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).cast("long").alias(c) for c in NODE], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def subtree_sums(prefixes: DataFrame, owned: DataFrame) -> DataFrame:
    """(name, saved_tokens, n_leaves): sums of value and leaf over each node's subtree.

    prefixes: (conv_id, depth, name). owned: (conv_id, depth, value, leaf), each node at its smallest member, so the
    nodes of a conversation are the end of its path.
    """
    rows = prefixes.join(owned, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("value", "leaf")})
    rows = rows.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "stretch", "name", F.sum("value").over(below).alias("value"), F.sum("leaf").over(below).alias("leaf"))
    # of a conversation of several stretches, what the later ones add: a row per stretch
    nth = F.floor(F.col("depth") / STRETCH)
    stretches = prefixes.where(F.col("depth") % STRETCH == 0).select("conv_id", F.explode(F.when(nth == 1, F.array(F.lit(0).cast("long"), nth)).otherwise(F.array(nth))).alias("stretch"))
    parts = owned.groupBy("conv_id", nth.alias("stretch")).agg(F.sum("value").alias("v"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    parts = stretches.join(parts, ["conv_id", "stretch"], "left")
    parts = parts.select("conv_id", "stretch", F.sum("v").over(later).alias("more_value"), F.sum("l").over(later).alias("more_leaf"))
    rows = rows.join(parts, ["conv_id", "stretch"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
    return rows.groupBy("name").agg(total("value").alias("saved_tokens"), total("leaf").alias("n_leaves"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one name, joined by commas, in rows of at most IDS."""
    name, first, ids = None, 0, []
    for b in batches:
        out = []
        for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != name or len(ids) == IDS:
                if ids:
                    out.append((name, first, ",".join(ids)))
                name, first, ids = n, c, []
            ids.append(str(c))
        yield _rows(out)
    if ids:
        yield _rows([(name, first, ",".join(ids))])


def _rows(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
    names, firsts, texts = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["name", "first", "ids"])


def _digest_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("name", pa.int64()), ("ends_sha256", pa.string())])
    name, digest = None, None
    for b in batches:
        out = []
        for n, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if n != name:
                if digest:
                    out.append({"name": name, "ends_sha256": digest.hexdigest()})
                name, digest = n, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest:
        yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": digest.hexdigest()}], schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id). Ids are ranged, so those of one name are joined in several tasks; then one hash runs along the joined rows of a name, holding none."""
    dealt = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").select("name", "conv_id")
    runs = dealt.mapInArrow(_runs, "name bigint, first bigint, ids string")
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_digest_along, "name bigint, ends_sha256 string")


# -- the query -------------------------------------------------------------------------------------------------------


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) and (conv_id, pos, key, words) of conversations that begin as another one does.

    Conversation c has the first h turns of c - c % 20, or all if they are fewer, and then its own without its first h,
    where h is crc32 of c's digits, modulo 4.
    """
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = turns.where("pos < 3 and conv_id % 20 = 0").groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 20, "h": h(F.col("conv_id"))})
    convs = stash(convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))))
    begun = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.key", "t.words")
    # where the other one is too short, own turns move up
    short = convs.where(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("up"), F.col("n").alias("rows"))
    own = lookup(turns.where(F.col("pos") >= h(F.col("conv_id"))), short, ["conv_id"], turns.count())
    own = own.select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "key", "words")
    return convs.select("conv_id"), begun.unionByName(own)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = stash(ordered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(*rebuilt(turns))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM (
    SELECT conv_id, turn, sha256(CAST(length(r) AS VARCHAR) || ':' || r || x) AS key, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], CAST(range(0, 8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))), 4294967295), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, c.h, t.pos, t.key, t.words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h),
n AS (SELECT c.conv_id, c.h, (SELECT count(*) FROM b WHERE b.conv_id = c.conv_id) AS got FROM c),
r AS (
  SELECT conv_id, pos, key, words FROM b UNION ALL SELECT t.conv_id, t.pos - n.h + n.got, t.key, t.words FROM t JOIN n ON t.conv_id = n.conv_id AND t.pos >= n.h),
l AS (SELECT n.conv_id, count(r.pos) AS length, coalesce(list(r.key ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS keys, coalesce(list(r.words ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS words FROM n LEFT JOIN r ON r.conv_id = n.conv_id GROUP BY n.conv_id),
p AS (
  SELECT conv_id, d AS depth, length, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, sha256(array_to_string(keys[1:d], ',')) AS name, CASE WHEN d = 0 THEN NULL ELSE sha256(array_to_string(keys[1:d - 1], ',')) END AS parent
  FROM (SELECT *, unnest(range(0, length + 1)) AS d FROM l)),
g AS (
  SELECT depth, name, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256 FROM p GROUP BY depth, name),
k AS (SELECT g.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM g x WHERE x.depth = g.depth + 1 AND x.parent = g.name) AS n_children FROM g LEFT JOIN g q ON q.depth = g.depth - 1 AND q.name = g.parent),
s AS (
  SELECT u.depth, u.name, sum(k.saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM k JOIN p v ON v.conv_id = k.conv_id AND v.depth = k.depth JOIN p u ON u.conv_id = v.conv_id AND u.depth <= v.depth GROUP BY u.depth, u.name)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256 FROM k JOIN s ON s.depth = k.depth AND s.name = k.name
"""
