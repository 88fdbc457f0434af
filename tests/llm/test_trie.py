import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from folioscope.llm import conversation_trie as C
from folioscope.llm import queries


def plain(rows, shared=4, group=20):
    """The trie by its definition; rows: conv_id, turn, role, text."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for _, _, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        whole[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    words = lambda node: len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words(node)
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items())


def check(spark, rows, tmp_path, extra=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, depth string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in queries.op12_conversation_trie(spark, str(tmp_path)).collect())
    assert got == plain(rows)
    return got


def table(seed=1, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for turn in range(rnd.randrange(1, 7)):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "a b c", "", None, f"w {rnd.randrange(4)}", " x\ty "])))
    return rows


@pytest.mark.parametrize("shard_turns", [5, 60, 1 << 16])
def test_trie_equals_plain_version(spark, tmp_path, monkeypatch, shard_turns):
    monkeypatch.setattr(C, "SHARD_TURNS", shard_turns)
    rows = table() + [(c, t, "user", f"copy {t}") for c in range(900, 960) for t in range(4)] + [(5000, None, "user", "null turn"), (5000, 3, "user", "later"), (None, 1, "user", "nowhere"), (-7, 0, "user", "hi")]
    assert len(check(spark, rows, tmp_path)) > 200


@pytest.mark.parametrize("shard_turns", [3, 40])
def test_long_conversations_in_segments(spark, tmp_path, monkeypatch, shard_turns):
    monkeypatch.setattr(C, "SEGMENT", 3)
    monkeypatch.setattr(C, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(C, "ENDS", 4)
    rnd = random.Random(2)
    rows = []
    for c in range(60):
        kind, n = rnd.randrange(3), rnd.choice([1, 2, 3, 4, 6, 7, 11])
        rows += [(c, t, "user", f"long text {kind} {t if t < 5 else rnd.randrange(2)}") for t in range(n)]
    check(spark, rows, tmp_path)


def test_repeated_rows_and_ties(spark, tmp_path):
    rows = [(c, 1, "user", "same") for c in (20, 21, 22) for _ in range(5)]
    check(spark, rows, tmp_path)


def test_empty_table(spark):
    assert C.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_tree_is_balanced_by_medians():
    assert sorted(C.medians(100)) == list(range(100))
    tree = C.Tree(0, 0)
    for i in C.medians(1023):
        tree.insert((0, 0, i, [i], [1], [1], [1]))
    depth = {0: 0}
    stack, most = [(tree.below[0], 1)], 0
    while stack:
        i, d = stack.pop()
        if i >= 0:
            most = max(most, d)
            stack += [(tree.low[i], d + 1), (tree.high[i], d + 1)]
    assert most == 10 and depth
