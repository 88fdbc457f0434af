"""Prefix trie of conversations: ternary search trees over dictionary-encoded turns, one for each range shard.

1. Distinct turns (role and text) get numbers from a dictionary table; turns are put in order by ranks that are counted inside
   range partitions on top of each partition's offset, so that no conversation meets in one task.
2. A conversation is cut into segments of SEGMENT turns. Segments of one level (first, second, ...) that follow the same prefix
   form a trie of their own; it hangs from the node at which that prefix ends. Levels are done from the deepest up, and hand
   what is below a node on to the level above.
3. Segments are sorted by prefix, turns and conversation, and cut into shards of SHARD_TURNS turns by range: a group of copies of
   any size is spread over shards. A shard's sequences are put into a ternary search tree, medians first; a walk from the
   newest node to the oldest adds up members, children, leaves and savings.
4. Only nodes on the paths of a shard's first and last sequence can go on in another shard. Those are merged: what hangs from
   them inside shards is summed, and sums below each are taken along these paths.

Nodes are told apart by 128 bits of hash of their turns, and by their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import checkpointed, tidy

#: Turns of a segment, turns of a shard, ids of a piece of a list of ends.
SEGMENT, SHARD_TURNS, ENDS = 256, 1 << 16, 1 << 16
#: A turn is looked up in a broadcast part of the dictionary if it comes in more than one of so many rows.
HOT = 1000
SPACE = r"[\x20\x09-\x0D]+"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (of role and text), n_words, u (a number that only parts equal rows)."""
    c = conversations.where("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    words = F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")
    rows = c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), words.alias("n_words"), F.xxhash64(F.monotonically_increasing_id()).alias("u"))
    rows = checkpointed(rows)
    words = checkpointed(rows.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    often = F.col("n") > max(HOT, rows.count() // HOT)  # no more than HOT rows
    hot = rows.join(F.broadcast(words.where(often).select("a", "b", "id")), ["a", "b"], "left")
    rest = hot.where("id IS NULL").drop("id").join(words.where(~often).select("a", "b", "id"), ["a", "b"])
    return hot.where("id IS NOT NULL").unionByName(rest).select("conv_id", "turn", "id", "n_words", "u")


def rebuilt(conversations: DataFrame, shared: int, group: int) -> DataFrame:
    """conv_id, pos, id, n_words, len of every turn of the rebuilt conversations, and a row without id where one ends at a
    multiple of SEGMENT, so that its last segment is an empty one.

    Conversation c starts with the first h turns of c - c % group and goes on with its own after its first h, where h is a hash
    of c below `shared`.
    """
    rows = encoded(conversations)
    order = ["turn", "id", "u"]
    rows = checkpointed(rows.repartitionByRange(partitions(rows), "conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = checkpointed(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")))
    c = counts.groupBy("conv_id").agg(F.sum("n").alias("size"))
    c = c.withColumn("base", F.expr(f"conv_id - conv_id % {group}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    c = c.join(c.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    c = c.withColumn("m", F.least("h", F.coalesce("base_size", F.lit(0)))).withColumn("len", F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    c = checkpointed(c.select("conv_id", "base", "h", "m", "len"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("conv_id", "part", before.alias("off")).join(c, "conv_id")
    inside = F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order))
    placed = checkpointed(rows.withColumn("k", inside).join(offsets, ["conv_id", "part"]).withColumn("pos", F.col("off") + F.col("k") - 1).select("conv_id", "base", "pos", "id", "n_words", "h", "m", "len"))
    own = placed.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "n_words", "len")
    heads = placed.where(f"conv_id = base AND pos < {shared}").select("base", "pos", "id", "n_words")
    heads = c.where("m > 0").join(heads, "base").where("pos < m").select("conv_id", "pos", "id", "n_words", "len")
    none = c.where(F.col("len") % SEGMENT == 0).select("conv_id", F.col("len").alias("pos"), *[F.lit(None).cast("long").alias(x) for x in ("id", "n_words")], "len")
    return own.unionByName(heads).unionByName(none)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, k, len, x, y (hash of the prefix before segment k), ids, words, hx, hy: the arrays have one element a turn."""
    k = F.expr(f"pos div {SEGMENT}")
    item = F.when(F.col("id").isNotNull(), F.struct("pos", "id", "n_words", F.xxhash64(F.lit(3), "pos", "id").alias("hx"), F.xxhash64(F.lit(4), "id", "pos").alias("hy")))
    s = turns.select("conv_id", "len", k.alias("k"), item.alias("t")).groupBy("conv_id", "k").agg(F.max("len").alias("len"), F.sort_array(F.collect_list("t")).alias("t"), F.bit_xor("t.hx").alias("tx"), F.bit_xor("t.hy").alias("ty"))
    s = checkpointed(s)
    before = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    long = s.where(F.col("len") >= SEGMENT).select("conv_id", "k", F.bit_xor("tx").over(before).alias("x"), F.bit_xor("ty").over(before).alias("y"))
    s = s.join(long, ["conv_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return s.select("conv_id", "k", "len", zero("x"), zero("y"), F.col("t.id").alias("ids"), F.col("t.n_words").alias("words"), "t.hx", "t.hy")


class Tree:
    """A ternary search tree whose nodes are a trie's; node 0 is the root. Parents are older than their children."""

    def __init__(self, x: int, y: int):
        self.id, self.low, self.high, self.below, self.parent, self.depth = [0], [-1], [-1], [-1], [-1], [0]
        self.x, self.y, self.words = [x], [y], [0]
        self.n, self.least = [0], [None]
        self.children, self.leaves, self.saved = [0], [0], [0]

    def node(self, parent: int, row: tuple) -> int:
        """A new node below parent, of the turn of row that comes there."""
        d = self.depth[parent]
        for column, value in (
            (self.id, row[3][d]), (self.low, -1), (self.high, -1), (self.below, -1), (self.parent, parent), (self.depth, d + 1), (self.x, self.x[parent] ^ row[5][d]), (self.y, self.y[parent] ^ row[6][d]),
            (self.words, row[4][d]), (self.n, 0), (self.least, None), (self.children, 0), (self.leaves, 0), (self.saved, 0),
        ):
            column.append(value)
        return len(self.id) - 1

    def insert(self, row: tuple) -> int:
        """The node at which the sequence of row ends."""
        at = 0
        for t in row[3]:
            i, side, from_ = self.below[at], self.below, at
            while i >= 0 and self.id[i] != t:
                side, from_ = (self.low if t < self.id[i] else self.high), i
                i = side[i]
            if i < 0:
                i = side[from_] = self.node(at, row)
            at = i
        return at


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(a, m), (m + 1, b)]


NODE = "shard string, kind int, depth long, x long, y long, px long, py long, n long, conv_id long, parent_conv_id long, children long, leaves long, saved long, words long, below long, first boolean, last boolean"
INNER, EDGE, END = 0, 1, 2


def walk(rows: list[tuple], shard: str, top: int) -> list[tuple]:
    """Rows of NODE of one shard; rows are sorted: x, y, conv_id, ids, words, hx, hy, ends, and what is below: children, leaves, saved."""
    out: list[tuple] = []
    groups, at = [], 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][:2] != rows[at][:2]:
            groups.append(rows[at:i])
            at = i
    for g, group in enumerate(groups):
        tree = Tree(*group[0][:2])
        ends = [0]  # where a run of equal sequences begins
        ends += [i for i in range(1, len(group)) if group[i][3] != group[i - 1][3]]
        last_of: dict[int, int] = {}
        for m in medians(len(ends)):
            at, stop = ends[m], ends[m + 1] if m + 1 < len(ends) else len(group)
            node = last_of[m] = tree.insert(group[at])
            tree.n[node] += stop - at
            tree.least[node] = group[at][2]
            for r in group[at:stop]:
                tree.children[node] += r[8]
                tree.leaves[node] += r[9]
                tree.saved[node] += r[10]
                if r[7]:
                    out.append((shard, END, top + tree.depth[node], tree.x[node], tree.y[node], None, None, None, r[2], None, None, None, None, None, None, None, None))
        below = tree.children[:]  # children in the level below alone
        edge: list[set[int]] = [set(), set()]
        for k, (is_edge, m) in enumerate(((g == 0, 0), (g == len(groups) - 1, len(ends) - 1))):
            node = last_of[m] if is_edge else -1
            while node >= 0:
                edge[k].add(node)
                node = tree.parent[node]
        edges = edge[0] | edge[1]
        for i in range(len(tree.id) - 1, 0, -1):  # children before their parents
            p = tree.parent[i]
            tree.n[p] += tree.n[i]
            tree.least[p] = tree.least[i] if tree.least[p] is None else min(tree.least[p], tree.least[i])
            if i not in edges:
                tree.leaves[i] = tree.leaves[i] if tree.children[i] else 1
                tree.saved[i] += (tree.n[i] - 1) * tree.words[i]
                tree.children[p] += 1
                tree.leaves[p] += tree.leaves[i]
                tree.saved[p] += tree.saved[i]
        for i in range(len(tree.id)):
            p = tree.parent[i]
            parent = None if p < 0 or p in edges else tree.least[p]
            kind = EDGE if i in edges else INNER
            out.append((
                shard, kind, top + tree.depth[i], tree.x[i], tree.y[i], tree.x[p] if p >= 0 else None, tree.y[p] if p >= 0 else None, tree.n[i], tree.least[i], parent, tree.children[i], tree.leaves[i], tree.saved[i],
                tree.words[i], below[i], i in edge[0], i in edge[1],
            ))
    return out


def shards(level: DataFrame, top: int) -> DataFrame:
    """NODE rows of all shards of one level, whose segments begin at depth `top`."""
    order = ["x", "y", "ids", "conv_id"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 13, pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, rows, turns = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            found = walk(rows, f"{part:09d}-{k:09d}", top)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                turns += len(row[3]) + 1
                if turns >= SHARD_TURNS:
                    yield done()
                    k, rows, turns = k + 1, [], 0
        if rows:
            yield done()

    rows = level.select("x", "y", "conv_id", "ids", "words", "hx", "hy", "ends", "below", "below_leaves", "below_saved")
    return rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).mapInArrow(run, NODE)


KEY = ["depth", "x", "y"]
RESULT = [*KEY, "n", "conv_id", "parent_conv_id", "children", "leaves", "saved"]


def merged(found: DataFrame) -> DataFrame:
    """RESULT rows of one level from its shards' NODE rows: edges put together, all others as they are."""
    edges = found.where(F.col("kind") == EDGE)
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    total = edges.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "below")], *[F.min(c).alias(c) for c in ("conv_id", "words", "px", "py")])
    total = checkpointed(total)
    more = total.where("px IS NOT NULL").select(*up).groupBy(*KEY).agg(F.count("*").alias("more"))
    total = total.join(more, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    # what a node adds to the sums of all nodes above it, besides other edges
    total = total.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")})
    total = checkpointed(total.select(*KEY, "n", "conv_id", "px", "py", "children", "leaves", "saved"))

    # a path is a shard's first or last sequence; each edge's share is counted on one of the paths through it
    path = lambda side: edges.where(side).select(F.concat("shard", F.lit(side)).alias("path"), *KEY)
    paths = checkpointed(path("first").unionByName(path("last")))
    owner = paths.groupBy(*KEY).agg(F.min("path").alias("owner"))
    shares = paths.join(owner, KEY).join(total.select(*KEY, "leaves", "saved"), KEY)
    below = W.partitionBy("path").orderBy(F.desc("depth"))
    mine = lambda c: F.sum(F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)).over(below).alias(c)
    sums = shares.select(*KEY, mine("leaves"), mine("saved")).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = checkpointed(total.drop("leaves", "saved").join(sums, KEY))

    least = whole.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    above = lambda df, *extra: df.withColumns({"d": F.col("depth") - 1}).join(least_of(least, extra), [F.col("d") == F.col("d2"), F.col("px") == F.col("x2"), F.col("py") == F.col("y2"), *[F.col(c) == F.col(f"{c}2") for c in extra]], "left")
    out = above(whole).select(RESULT)
    inner = found.where(F.col("kind") == INNER)
    out = out.unionByName(inner.where("parent_conv_id IS NOT NULL OR px IS NULL").select(RESULT))
    # below an edge: the parent's whole smallest member is looked up in the shard, so that no node's children meet
    least = edges.select("shard", *KEY).join(least, KEY)
    return out.unionByName(above(inner.where("parent_conv_id IS NULL AND px IS NOT NULL").drop("parent_conv_id"), "shard").select(RESULT))


def least_of(least: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    return least.select(F.col("depth").alias("d2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "parent_conv_id", *[F.col(c).alias(f"{c}2") for c in extra])


def end_hashes(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the ascending ids of those that end at a node; ids are joined in pieces, pieces hashed one by one."""
    n = partitions(ends)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(KEY, key)), "least": ids[0], "ids": ",".join(map(str, ids))}], pa.schema([*[(c, pa.int64()) for c in KEY], ("least", pa.int64()), ("ids", pa.string())]))

        found: list[pa.RecordBatch] = []
        for batch in batches:
            for *k, c in zip(*[x.to_pylist() for x in batch.columns]):
                if ids and (k != key or len(ids) >= ENDS):
                    found.append(out())
                    ids = []
                key = k
                ids.append(c)
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
                found = []
        if ids:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            rows: list[tuple] = []
            for *k, text in zip(*[x.to_pylist() for x in batch.columns]):
                if k != key:
                    if sha:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield as_batch(rows)
        if sha:
            yield as_batch([(*key, sha.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    found = ends.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, "depth long, x long, y long, least long, ids string")
    return found.repartition(n, *KEY).sortWithinPartitions(*KEY, "least").select(*KEY, "ids").mapInArrow(hashes, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shared: int = 4, group: int = 20) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see `rebuilt`): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of `turn`, null first; turns of one number, repeated rows among them, are ordered by an arbitrary number
    of their role and text. A null role or text is empty; rows without conv_id belong to no conversation and are left out. An
    empty table gives an empty result. Other columns are not read. Texts are only hashed and counted; conversations may be of
    any length.
    """
    with tidy(conversations.sparkSession):
        all_segments = checkpointed(segments(rebuilt(conversations, shared, group)))
        deepest = all_segments.agg(F.max("k")).first()[0]
        nodes, ends, roots = [], [], None
        for k in range(-1 if deepest is None else deepest, -1, -1):
            top = k * SEGMENT
            level = all_segments.where(F.col("k") == k).withColumn("ends", F.col("len") < top + SEGMENT)
            zero = F.lit(0).cast("long")
            if roots is None:
                level = level.withColumns({c: zero for c in ("below", "below_leaves", "below_saved")})
            else:
                level = level.join(roots.select("conv_id", F.col("children").alias("below"), F.when(F.col("children") > 0, F.col("leaves")).alias("below_leaves"), F.col("saved").alias("below_saved")), "conv_id", "left").fillna(0, ["below", "below_leaves", "below_saved"])
            found = checkpointed(shards(level, top))
            result = checkpointed(merged(found))
            ends.append(found.where(F.col("kind") == END).select(*KEY, "conv_id"))
            nodes.append(result.where(F.col("depth") > top) if k else result)
            roots = result.where(F.col("depth") == top)
        if not nodes:
            return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
        every, end = nodes[0], ends[0]
        for x, y in zip(nodes[1:], ends[1:]):
            every, end = every.unionByName(x), end.unionByName(y)
        out = every.join(end_hashes(end), KEY, "left")
        out = out.select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
        return checkpointed(out, lasting=True)
