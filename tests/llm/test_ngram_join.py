import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from folioscope.llm import ngram_join


def sets_of(rows, width):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return sets


def brute(rows, width=4, num=85, den=100):
    """component_id and n_shingles by row, from all pairs of sets that share a shingle."""
    sets = sets_of(rows, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j < i)
        for j, k in shared.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), doc if not s else least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int")
    got = ngram_join.similar_groups(docs.repartition(3), **kw).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, **kw), key=key)


def family(rnd, n, words, edits):
    base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rnd.randrange(edits)):
            k = rnd.randrange(len(x))
            x[k : k + rnd.randrange(2)] = [f"v{rnd.randrange(10**6)}"] * rnd.randrange(2)
        out.append(" ".join(x))
    return out


def test_against_all_pairs(spark):
    rnd = random.Random(7)
    texts = [None, "", " \t", "one", "One", "one two", "one two three", "ONE two\nthree four", "one two three four", "É one", "é one"]
    for words, edits in ((40, 4), (80, 8), (150, 9), (150, 14), (300, 20)):
        texts += family(rnd, 30, words, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(4, 90))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(500, rows[3][1]), (None, rows[4][1]), (None, None), (rows[5][0], rows[5][1]), (rows[6][0], "quite another text for this id here")]
    check(spark, rows)


def test_tiles_and_fans(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    monkeypatch.setattr(ngram_join, "FAN", 4)
    monkeypatch.setattr(ngram_join, "PEERS", 5)
    rnd = random.Random(9)
    rows = list(enumerate(family(rnd, 90, 150, 18) + family(rnd, 50, 60, 9)))
    check(spark, rows)
    check(spark, rows[:60], width=5, num=8, den=10)


def test_empty(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "")])


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(200, 200 + i) for i in range(50)]
    got = dict(map(tuple, ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_bound_holds_for_all_sizes():
    for num, den in ((85, 100), (80, 100), (1, 2)):
        t = ngram_join.Trie(num, den)
        for n in range(1, 90):
            sizes = range(-(-num * n // den), den * n // num + 1)
            for least in sizes:
                lowest = 1 << 30
                for largest in range(least, sizes[-1] + 1):
                    lowest = min(lowest, t.least_shared(n, largest))
                    assert t.least_below(n, least, largest) <= lowest


def test_link_to_a_big_component_in_both_node_orders(spark):
    tail = set(range(4, 21))
    sets = {"A": {0} | tail, "B": {1, 2} | tail, "C": {1, 3} | tail - {20}, "D": {1, 2, 3} | tail}
    similar = lambda x, y: 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])
    assert [x + y for x in "ABCD" for y in "ABCD" if x < y and similar(x, y)] == ["AB", "BC", "BD", "CD"]
    for order in ("CDBA", "DCBA", "ABCD", "BACD"):
        ids = {x: 10 + i for i, x in enumerate(order)}
        rows = [(ids[x], i, i, len(s), sorted(s)[: ngram_join.prefix_length(len(s), 85, 100)]) for i, (x, s) in enumerate(sets.items())]
        rows = [(*r, *[ngram_join.sketch_of(np.array(sorted(sets[order[r[0] - 10]]), np.uint64))] * 2) for r in rows]
        nodes = spark.createDataFrame(rows, "node long, doc_id long, key long, n long, prefix array<long>, sketch binary, rough binary")
        members = ngram_join.checkpointed(ngram_join.block_members(nodes))
        first = {tuple(sorted((r.lead, r.node))) for r in members.collect() if r.lead != r.node}
        links = [(a, b) for a, b in first if similar(order[a - 10], order[b - 10])]
        roots = ngram_join.components(spark.createDataFrame(links, "a long, b long"))
        schema = "block long, i long, j long, node long, key long, comp long, partners array<long>"
        tiles = ngram_join.tile_rows(members, roots, nodes, 85, 100)
        got = tiles.mapInArrow(lambda it: ngram_join.walk_tiles(it, 85, 100), schema).collect() if tiles is not None else []
        found = {tuple(sorted((r.node, x))) for r in got for x in r.partners}
        assert tuple(sorted((ids["A"], ids["B"]))) in found | set(links), order


def test_sets_of_texts():
    rnd = random.Random(4)
    words = ["a", "B", "b", "ab", "ba", "É", "é", "x" * 50, "\x1f", "\xa0", "中文", "aa", "aaa", "0"]
    texts = [None, "", " ", "a", "A\tb", *[rnd.choice(["", " "]) + rnd.choice([" ", "\n", "\r\x0b "]).join(rnd.choices(words, k=rnd.randrange(60))) for _ in range(300)]]
    grams = ngram_join.Grams(3)
    column = pa.array(["left out", *texts])[1:]
    sets = [frozenset(g.tolist()) for g in grams(column)]
    plain = [sets_of([(0, t)], 3)[0] for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a in range(0, len(texts), 7):
        assert [len(sets[a] & s) for s in sets] == [len(plain[a] & s) for s in plain]


def test_long_texts_are_read_in_slices(monkeypatch):
    text = " ".join(f"w{i % 977} {'y' * (i % 50)}" for i in range(4000)) + " " + "z" * 9000 + " end of it"
    whole = next(iter(ngram_join.Grams(4)(pa.array([text]))))
    monkeypatch.setattr(ngram_join, "SLICE", 500)
    got = list(ngram_join.Grams(4)(pa.array(["short one", text, None, text + " more"])))
    assert got[1].tolist() == whole.tolist() and len(got[2]) == 0 and set(whole) < set(got[3])


def test_sketches_bound_the_difference():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 1200)
        x = {rnd.randrange(1 << 63) for _ in range(n)}
        y = set(rnd.sample(sorted(x), rnd.randrange(1, n + 1))) | {rnd.randrange(1 << 63) for _ in range(rnd.randrange(40))}
        a, b = (ngram_join.Sketch(ngram_join.sketch_of(np.array(sorted(s), np.uint64))) for s in (x, y))
        assert a.apart(b) <= len(x ^ y)
        assert a.apart(a) == 0


def test_long_paths_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "AHEAD", 3)
    monkeypatch.setattr(ngram_join, "BEHIND", 2)
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rnd = random.Random(11)
    rows = list(enumerate(family(rnd, 80, 200, 26) + family(rnd, 40, 40, 6)))
    rows += [(None, t) for t in family(rnd, 30, 90, 9)] + [(7, t) for t in family(rnd, 30, 90, 9)]
    check(spark, rows)
