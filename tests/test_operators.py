import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from folioscope.functions import expr as X
from folioscope.operators import blocks as B
from folioscope.operators import crawl, diff, links, sections, sync, tree
from folioscope.sources import files
from folioscope.sources.mappings import clean_mappings, load_mappings


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("j", "line"))


def test_diff_invariants(spark):
    """Matches have equal texts, rise on both sides, and the rows of a diff cover both sides once."""
    rnd = random.Random(5)
    old = [[rnd.choice("abcdefgh") + rnd.choice("12") for _ in range(rnd.randrange(1, 25))] for _ in range(60)]
    new = [[x for x in o if rnd.random() > 0.2] + [rnd.choice("abxy")] * rnd.randrange(3) for o in old]
    for n in new:
        if rnd.random() < 0.4 and len(n) > 2:
            n[0], n[-1] = n[-1], n[0]
    a, b = lines_of(spark, ["\n".join(x) for x in old]), lines_of(spark, ["\n".join(x) for x in new])
    m = diff.diff_align(a, b)
    got = {}
    for r in m.collect():
        got.setdefault(r.doc_id, []).append((r.l, r.r))
    for d, pairs in got.items():
        pairs.sort()
        right = "\n".join(new[d]).split("\n")
        assert all(old[d][x] == right[y] for x, y in pairs) and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        once = [x for x in set(old[d]) if old[d].count(x) == 1 == right.count(x)]
        if sorted(once, key=old[d].index) == sorted(once, key=right.index):
            assert set(once) <= {old[d][x] for x, _ in pairs}
    rows = diff.opcodes(a, b, m).collect()
    for d in range(60):
        own = [r for r in rows if r.doc_id == d]
        assert sorted(r.l for r in own if r.l is not None) == list(range(len(old[d])))
        assert sorted(r.r for r in own if r.r is not None) == list(range(len("\n".join(new[d]).split("\n"))))


@pytest.mark.parametrize("n", [2])
def test_restyles_are_found(spark, n):
    """Every pair of sequences of two words in four styles: a line whose text stays is never lost."""
    words, styles = ["A", "B"], ["", "# ", "- ", "> "]
    seqs = list(itertools.product(itertools.product(words, repeat=n), itertools.product(styles, repeat=n)))
    rnd = random.Random(1)
    cases = [(x, y) for x in seqs for y in seqs if x[0] == y[0]]
    cases = rnd.sample(cases, 150)
    text = lambda s: "\n".join(st + w for w, st in zip(*s))
    a, b = lines_of(spark, [text(x) for x, _ in cases]), lines_of(spark, [text(y) for _, y in cases])
    got = diff.style_align(a, b).groupBy("doc_id").count().collect()
    assert len(got) == len(cases) and all(r["count"] == n for r in got)


def merge(spark, cases):
    sides = [lines_of(spark, [c[k] for c in cases]) for k in range(3)]
    return {r.doc_id: r for r in diff.merge3(*sides).collect()}


def test_merge3(spark):
    cases = [
        ("a\nb\nc", "a\nB\nc", "a\nb\nc"), ("a\nb\nc", "a\nb\nc", "a\nb\nC"), ("a\nb\nc", "x\nb\nc", "a\nb\ny"), ("a\nb\nc", "a\nX\nc", "a\nY\nc"), ("a\nb\nc", "a\nX\nc", "a\nX\nc"),
        ("a\nb\nc", "a\nb\nc", "a\nb\nc"), ("a", "a\nb", "a\nb"), ("a\nb", "b", "a"), ("", "x", ""), ("a\nb\nc\nd", "a\nc\nd", "a\nb\nc\nd\ne"),
    ]
    got = merge(spark, cases)
    assert [got[i].merged for i in (0, 1, 2, 4, 5, 6)] == ["a\nB\nc", "a\nb\nC", "x\nb\ny", "a\nX\nc", "a\nb\nc", "a\nb"]
    assert got[3].merged == "a\n<<<<<<< ours\nX\n=======\nY\n>>>>>>> theirs\nc" and got[3].has_conflicts and got[3].conflict_count == 1
    assert got[8].merged == "x" and got[9].merged == "a\nc\nd\ne" and not got[9].has_conflicts


def test_merge_laws(spark):
    rnd = random.Random(2)
    base = ["\n".join(rnd.choice("abcdef") + str(i) for i in range(8)) for _ in range(30)]
    edit = lambda t: "\n".join(x for x in t.split("\n") if rnd.random() > 0.2) + "\nend"
    x = [edit(t) for t in base]
    for cases, want in (([(b, y, b) for b, y in zip(base, x)], x), ([(b, b, y) for b, y in zip(base, x)], x), ([(b, y, y) for b, y in zip(base, x)], x)):
        got = merge(spark, cases)
        assert [got[i].merged for i in range(30)] == want and not any(r.has_conflicts for r in got.values())


def test_fences(spark):
    docs = ["a\n```\nx\n```\nb", "````\n```\n````\nz", "```py\nopen to the end", "~~~\n```\n~~~\nq", "no code", "```\n```\nx", "~~~\na\n~~~\nb"]
    got = {}
    for r in B.lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string")).orderBy("doc_id", "j").collect():
        got.setdefault(r.doc_id, []).append(r.in_code)
    assert got == {0: [False, True, True, True, False], 1: [True, True, True, False], 2: [True, True], 3: [True, True, True, False], 4: [False], 5: [True, True, False], 6: [True, True, True, False]}


def test_slugs(spark):
    heads = [["Intro", "Intro", "Intro 1"], ["Intro 1", "Intro", "Intro"], ["A b!", "a B", "A-b"], ["Über uns", "123", ""], ["x", "x", "x-1", "x", "x-1"]]
    rows = [(d, j, 1, t) for d, hs in enumerate(heads) for j, t in enumerate(hs)]
    got = {}
    for r in links.heading_slugs(spark.createDataFrame(rows, "doc_id long, j int, level int, title string")).orderBy("doc_id", "j").collect():
        got.setdefault(r.doc_id, []).append(r.slug)
    assert got == {0: ["intro", "intro-1", "intro-1-1"], 1: ["intro-1", "intro", "intro-2"], 2: ["a-b", "a-b-1", "a-b-2"], 3: ["über-uns", "123", ""], 4: ["x", "x-1", "x-1-1", "x-2", "x-1-2"]}


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(X.norm_path(lit("a\\b/./../c//d/../e.md"))) == "a/c/e.md" and one(X.norm_path(lit("../x"))) == "../x"
    assert one(X.anchor_target(lit("#a%20b+c"))) == "a b+c" and one(X.anchor_target(lit("#"))) is None and one(X.anchor_target(lit("x#y"))) is None
    assert one(X.cross_doc_path(lit("../a.md#x"))) == "../a.md" and one(X.cross_doc_path(lit("https://x/a.md"))) is None and one(X.cross_doc_path(lit("/a"))) is None and one(X.cross_doc_fragment(lit("a#b"))) == "b"
    assert one(X.snake_key(lit("fooBarHTTPKey"))) == "foo_bar_http_key" and one(X.snake_key(lit("Kebab-Case"))) == "kebab_case"
    assert one(X.utf16_len(lit("a\U0001f600"))) == 3 and one(X.private_use_only(lit("  "))) and not one(X.private_use_only(lit("a")))
    assert one(X.heading_rank(lit("HEADING_3"))) == 3 and one(X.heading_rank(lit("TITLE"))) == 0 and one(X.heading_rank(lit("NORMAL"))) is None
    assert one(X.front_matter(lit("---\na: 1\nb: 'x'\n---\nbody"))) == {"a": "1", "b": "x"} and one(X.front_matter(lit("none"))) == {}
    assert one(X.body_after_front_matter(lit("---\na: 1\n---\nbody"))) == "body" and one(X.macro_params(lit("a=1|b=2=3|c|a=4"))) == {"b": "2=3", "a": "4"}
    assert one(X.fence_for(lit("a ```` b"))) == "`````" and one(X.safe_filename(lit('a/b:c?"'))) == "a_b_c__"
    assert set(X.register(spark)) == set(X.SQL_FUNCTIONS) and spark.sql("SELECT fs_slugify(' A b ')").first()[0] == "a-b"


def test_sync_edges(spark):
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    old = mk([(1, 0, "", "s", "a.md"), (1, 1, "h1", "s", "b.md"), (1, 2, "", "t", "c.md"), (1, 3, "h3", "u", "d.md")], "doc_id long, pos int, heading_id string, slug string, filename string")
    new = mk([(1, 0, "", "s", "z.md"), (1, 1, "h1", "s", "y.md")], old.schema)
    assert [(r.old_name, r.new_name, r.kind) for r in sync.section_renames(old, new).collect()] == [("b.md", "y.md", "renumbered")]
    assert sorted(r.filename for r in sync.orphan_sections(old, new).collect()) == ["a.md", "c.md", "d.md"]
    heads = mk([(1, "h1", 0), (1, "h1", 1), (1, "h2", 1), (1, "", 0)], "doc_id long, heading_id string, tab int")
    assert [tuple(r) for r in tree.foreign_headings(heads).collect()] == [(1, "h2", 1)]
    boxes = mk([(1, 3), (1, 5), (2, 1)], "doc_id long, j int")
    states = mk([(1, 0, True), (1, 9, False), (2, 1, True), (2, 2, True)], "doc_id long, j int, checked boolean")
    assert sorted(map(tuple, crawl.checkbox_recover(boxes, states).collect())) == [(1, 3, True), (1, 5, False)]
    assert sync.state_upsert(mk([(1, "a"), (2, "b")], "k long, v string"), mk([(2, "c", "ok"), (3, "d", "error")], "k long, v string, status string"), "k").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text(" Local ,REMOTE_ID\n a.md , r1 \nb.md,\n")
    assert [tuple(r) for r in load_mappings(spark, f"file://{tmp_path}/m.csv", ["local", "remote_id"], ["local", "remote_id"]).collect()] == [("a.md", "r1")]
    with pytest.raises(ValueError):
        clean_mappings(spark.range(1), ["local"], ["local"])
    d = tmp_path / "docs"
    d.mkdir()
    (d / "x.md").write_text("one\ntwo")
    assert files.scan_documents(spark, f"file://{d}").first().content == "one\ntwo"
    i = tmp_path / "img"
    i.mkdir()
    for name, data in {"a": b"\x89PNG\r\n", "b": b"\xff\xd8\xff\xe0", "c": b"GIF89a", "d": b"<svg/>", "e": b"junk", "f": b"RIFF0000WEBP", "g": b"x" * 100}.items():
        (i / name).write_bytes(data)
    kinds = {r.path[-1]: r.kind for r in files.scan_images(spark, f"file://{i}", 50).collect()}
    assert kinds == {"a": "image/png", "b": "image/jpeg", "c": "image/gif", "d": "image/svg+xml", "e": None, "f": "image/webp"}
    log = spark.createDataFrame([(1, "a.md", "edit", "t")], files.CONFLICT)
    for _ in range(2):
        files.append_conflicts(log, f"file://{tmp_path}/log")
    assert files.read_conflicts(spark, f"file://{tmp_path}/log").count() == 2
    for v in (1, 2):
        files.write_state(spark.range(v), f"file://{tmp_path}/state", v)
    assert files.read_state(spark, f"file://{tmp_path}/state").count() == 2
    page = spark.createDataFrame([("1", "T", "S", 1, "current", "", "", "", "", None, "", ["l"])], files.PAGE)
    files.save_crawl(page, f"file://{tmp_path}/crawl")
    assert files.scan_crawl(spark, f"file://{tmp_path}/crawl").first().labels == ["l"]


def test_merge3_query_has_every_document(spark):
    from folioscope.plans import fixtures as V
    from folioscope.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    b, o, t = ({r.doc_id: r.content for r in f(spark, sf).collect()} for f in (V.base, V.ours, V.theirs))
    got = QUERIES["merge3"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(b)
    kinds = set()
    for r in got:
        x, y, z = b[r.doc_id], o[r.doc_id], t[r.doc_id]
        kinds.add((x == y, x == z))
        if x == y or x == z or y == z:
            assert (r.merged, r.has_conflicts, r.conflict_count) == (z if x == y else y, False, 0)
        assert r.merged is not None and r.has_conflicts == (r.conflict_count > 0)
    assert len(kinds) == 4


def test_front_matter_with_repeated_keys(spark):
    df = spark.createDataFrame([("---\na: 1\nb: 2\na: 3\n---\n",)], "content string")
    assert df.select(X.front_matter(F.col("content"))).first()[0] == {"b": "2", "a": "3"}


def flagged_lines(spark, *docs):
    rows = [(d, j, x, False) for d, text in enumerate(docs) for j, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id long, j int, line string, in_code boolean")


def test_sections_of_every_kind(spark):
    docs = flagged_lines(spark, "start\n# Intro\nfirst\n## Sub\n# Intro\nsecond", "# Intro-1\n# Intro\n# Intro", "no heading", "## Other level\ntext")
    got = sorted(map(tuple, sections.split_sections(docs, 1).collect()), key=str)
    assert (0, 0, 0, 1, "", None) in got and (0, 1, 1, 3, "Intro", None) in got and (0, 2, 4, 2, "Intro", None) in got
    assert (1, 0, None, 0, "", None) in got and (2, 0, 0, 1, "", None) in got
    assert [r for r in got if r[0] == 3] == [(3, None, None, 2, "", "no heading of level 1; the deepest is of level 2")]
    named = sections.section_slugs(sections.split_sections(docs, 1))
    slugs = {(r.doc_id, r.section): r.slug for r in named.collect()}
    assert slugs == {(0, 0): "preamble", (0, 1): "intro", (0, 2): "intro-1", (1, 0): "preamble", (1, 1): "intro-1", (1, 2): "intro", (1, 3): "intro-2", (2, 0): "preamble"}
    files = {(r.doc_id, r.section): r.filename for r in sections.section_files(named).collect()}
    assert files[0, 0] == "00-preamble.md" and files[0, 2] == "02-intro-1.md"
    known = spark.createDataFrame([(0, "h.1", "Intro", "intro-legacy"), (0, "h.2", "Was else", "else"), (0, "", "Intro", "no")], "doc_id long, heading_id string, title string, slug string")
    ided = sections.split_sections(docs, 1).withColumn("heading_id", F.concat(F.lit("h."), "section"))
    again = {(r.doc_id, r.section): r.slug for r in sections.section_slugs(ided, known).collect()}
    assert again == slugs | {(0, 1): "intro-legacy"}


def test_many_headings_of_one_document_are_quick(spark):
    titles = [t for i in range(3000) for t in ("Part", f"Part-{i}", "Other")]
    rows = spark.createDataFrame([(1, j, 2, t) for j, t in enumerate(titles)], "doc_id long, j int, level int, title string")
    began = time.time()
    got = [r.slug for r in links.heading_slugs(rows).orderBy("j").collect()]
    assert time.time() - began < 15 and len(set(got)) == len(got) == 9000


def plain_assign(left, right):
    """Pairs of (place, style) by score, then place, one by one."""
    def score(a, b):
        kind = lambda s: "h" if s.startswith("HEADING") else "i" if s in ("TASK", "ITEM") else "r"
        return 2 * (a == b) + ((kind(a) == "h") == (kind(b) == "h")) + ((kind(a) == "i") == (kind(b) == "i")) + (a == b == "QUOTE")

    pairs = sorted((-score(a, b), i, j) for i, a in enumerate(left) for j, b in enumerate(right) if score(a, b))
    used_l, used_r, out = set(), set(), set()
    for s, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i), used_r.add(j), out.add((i, j, -s))
    return out


def test_assignment_against_one_by_one(spark):
    rnd = random.Random(3)
    marks = {"HEADING_1": "# ", "HEADING_2": "## ", "TASK": "- [ ] ", "ITEM": "- ", "QUOTE": "> ", "TEXT": ""}
    docs = []
    for _ in range(40):
        sides = []
        for _ in "lr":
            some = rnd.sample(sorted(marks), rnd.randrange(1, 5))
            sides.append([rnd.choice(some) for _ in range(rnd.randrange(12))])
        docs.append(sides)
    frame = lambda k: spark.createDataFrame([(d, j, marks[s] + "same") for d, x in enumerate(docs) for j, s in enumerate(x[k])], "doc_id long, j int, line string")
    none = spark.createDataFrame([], "doc_id long, l int, r int")
    got = {}
    for r in diff.diff_assign(frame(0), frame(1), none).collect():
        got.setdefault(r.doc_id, set()).add((r.l, r.r, r.score))
    for d, (a, b) in enumerate(docs):
        assert got.get(d, set()) == plain_assign(a, b), (a, b)


def test_repeated_text_is_no_pair_list(spark):
    rows = [(1, j, f"{'- ' if j % 2 else ''}same") for j in range(1800)]
    side = spark.createDataFrame(rows, "doc_id long, j int, line string")
    began = time.time()
    got = diff.diff_assign(side, side, spark.createDataFrame([], "doc_id long, l int, r int"))
    assert got.count() == 1800 and time.time() - began < 15


def test_sql_functions_are_the_column_functions(spark):
    X.register(spark)
    texts = ["", "  Some Title (2) ", "#a%20b+c", "#", "../x/./y.md#Part-1", "https://e.org/a", "a\\\\b/../../c", "12345", "/wiki/spaces/AB/pages/77/T", "https://www.google.com/url?sa=D&q=https%3A%2F%2Fe.org%2Fx&ust=1", "fooBarHTTPServer-x", 'a<b>:"c"', "\ue000 ", "HEADING_3", "TITLE", "---\na: 1\nb: 'x'\na: 2\n---\n# Head\nbody", "```` x ``", "`t`", " s ", "k = v|w=1=2|k=3|z", "<p>" + "word " * 40 + "</p>", '{"editor":"v1"}', '{"body":{"storage":"x"}}', "{}"]
    one = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    pairs = {
        "strip": X.strip, "slugify": X.slugify, "anchor_target": X.anchor_target, "cross_doc_path": X.cross_doc_path, "cross_doc_fragment": X.cross_doc_fragment, "norm_path": X.norm_path, "page_id_of_url": X.page_id_of_url,
        "space_of_url": X.space_of_url, "unwrap_redirect": X.unwrap_redirect, "norm_page_name": X.norm_page_name, "snake_key": X.snake_key, "safe_filename": X.safe_filename, "utf16_len": X.utf16_len, "private_use_only": X.private_use_only,
        "heading_rank": X.heading_rank, "front_matter": X.front_matter, "fence_for": X.fence_for, "mermaid_key": X.mermaid_key, "macro_params": X.macro_params, "comment_preview": X.comment_preview, "editor_type": X.editor_type, "inline_code": X.inline_code,
    }
    row = one.select(*[f(s).alias(k) for k, f in pairs.items()], *[F.expr(f"fs_{k}(s)").alias(f"sql_{k}") for k in pairs]).collect()
    for k in pairs:
        assert [r[k] for r in row] == [r[f"sql_{k}"] for r in row], k
    assert one.select(F.expr("fs_doc_title('', s, 'a/b.c.md')").alias("a"), X.doc_title(F.lit(""), s, F.lit("a/b.c.md")).alias("b")).where("a <> b").count() == 0
    x = spark.createDataFrame([(i, v, 1.0, w, r) for i in (0.0, 9.0, 18.0, 27.0, 40.0, -18.0) for v in (1.0, 3.0) for w in ("SOLID", "DOT") for r in (0.494, 126 / 255, 0.6)], "indent double, width double, pad double, dash string, red double")
    args = [F.col("indent"), F.col("width"), F.col("dash"), F.col("red"), F.lit(0.549), F.lit(0.612)]
    got = x.select("*", X.quote_depth(*args).alias("a"), F.expr("fs_quote_depth(indent, width, dash, red, 0.549D, 0.612D)").alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.a for r in got} == {0, 1, 2} and all(r.a == 0 for r in got if r.width == 3 or r.red == 0.6 or r.indent <= 9)
    when = "timestamp'2024-01-01 00:10:00'"
    for other in ("timestamp'2024-01-01 00:10:30'", "timestamp'2024-01-01 00:02:00'", "timestamp'2024-01-01 01:00:00'"):
        r = spark.range(1).select(F.expr(f"fs_conflict_hint({when}, {other})"), X.conflict_hint(F.expr(when), F.expr(other)), F.expr(f"fs_modified_since({when}, {other})"), X.modified_since(F.expr(when), F.expr(other)), F.expr(f"fs_oneway_action({when}, true, {when}, {other})"), X.oneway_action(F.expr(when), F.lit(True), F.expr(when), F.expr(other))).first()
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r[5]
