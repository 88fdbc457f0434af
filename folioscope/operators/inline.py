"""Inline marks of a line: where they are, what they say, and a line as nodes of a tree."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of inline marks. Where two begin at one place, the earlier in this list counts.
PATTERNS = {
    "link": r'\[([^\]]+)\]\(([^)\s]+)(?:\s+"([^"]+)")?\)',
    "image": r'!\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]+)")?(?:\s+=(\d+)(?:x(\d+))?)?\)',
    "bold": r"\*\*([^*]+)\*\*|\b__([^_]+)__\b",
    "italic": r"\*([^*]+)\*|\b_([^_]+)_\b",
    "bold_italic": r"\*\*\*([^*]+)\*\*\*|\b___([^_]+)___\b",
    "code": r"`([^`]+)`",
    "strike": r"~~([^~]+)~~",
    "emoji": r":([a-z0-9_+-]+):",
    "mention": r"@([a-zA-Z0-9._-]+)",
    "status": r"\[!([A-Z_]+)\]",
    "highlight": r"==([^=]+)==",
    "colour": r'<mark[^>]*style="color:([^"]+)"[^>]*>([^<]+)</mark>',
    "date": r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?",
    "macro": r"\{([a-z][a-z0-9-]*)(?::([^}]+))?\}",
}
#: Colours of status badges; all others are neutral.
STATUS_COLOURS = {
    "DONE": "green", "COMPLETE": "green", "SUCCESS": "green", "PASSED": "green", "APPROVED": "green", "ERROR": "red", "FAILED": "red", "BLOCKED": "red", "REJECTED": "red",
    "WARNING": "yellow", "PENDING": "yellow", "REVIEW": "yellow", "INFO": "blue", "IN_PROGRESS": "blue", "RUNNING": "blue", "OPTIONAL": "purple",
}
HIGHLIGHT = "#ffff00"
#: Lines without any of these hold no mark.
HINT = r"[\[`*_~:@=<{]|[0-9]{4}-"

_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS.items()]


def marks_of(line: str) -> list[tuple[int, str, re.Match]]:
    """Place, kind and match of the marks of a line, none overlapping: of those that do, the leftmost stays.

    Each kind's own matches do not overlap, whether they stay or not; so a mark that loses still covers its text for its kind.
    """
    found = sorted(((m.start(), k, kind, m) for k, (kind, p) in enumerate(_COMPILED) for m in p.finditer(line)), key=lambda x: x[:2])
    out, end = [], 0
    for start, _, kind, m in found:
        if start >= end:
            out.append((start, kind, m))
            end = m.end()
    return out


def parameters(text: str | None) -> dict[str, str]:
    """key=value pairs, parted by bars if there is any, else by commas."""
    pairs = (p.split("=", 1) for p in (text or "").split("|" if "|" in (text or "") else ",") if "=" in p)
    return {k.strip(): v.strip() for k, v in pairs}


def described(kind: str, m: re.Match) -> tuple[str, str, str | None, str | None]:
    """Kind, what the mark says, its target (an address, a title) and its colour."""
    g = [x for x in m.groups() if x is not None]
    if kind in ("link", "image"):
        return kind, m.group(1), m.group(2), None
    if kind == "status":
        return kind, g[0], None, STATUS_COLOURS.get(g[0], "neutral")
    if kind == "colour":
        return kind, m.group(2), None, m.group(1)
    if kind == "highlight":
        return kind, g[0], None, HIGHLIGHT
    if kind == "date":
        return kind, m.group(0), None, None
    if kind == "macro":
        p = parameters(m.group(2))
        if m.group(1) == "status":
            return "status", p.get("title", ""), None, p.get("colour", p.get("color", "Grey"))
        return kind, m.group(1), m.group(2), None
    return kind, g[0], None, None


MARKS = "doc_id long, j int, k int, kind string, start int, raw string, value string, target string, colour string"


def explode_inline(line_rows: DataFrame) -> DataFrame:
    """doc_id, j, k, kind, start, raw, value, target, colour of every inline mark outside code.

    Marks of all kinds are sought, those that overlap an earlier one go; ties in the order of PATTERNS. A status is a badge
    or a macro of that name, each with its colour. Which of a line's marks stay depends on those before, which no built-in
    function carries along; a small function does, a line at a time.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.string()] * 4]
    names = [x.split()[0] for x in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, j, line in zip(*[c.to_pylist() for c in batch.columns]):
                for k, (start, kind, m) in enumerate(marks_of(line)):
                    kind, value, target, colour = described(kind, m)
                    rows.append((doc, j, k, kind, start, m.group(0), value, target, colour))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    some = line_rows.where(~F.col("in_code") & F.col("line").rlike(HINT)).select("doc_id", F.col("j").cast("int").alias("j"), "line")
    return some.mapInArrow(run, MARKS)


def milliseconds(date: str) -> int:
    try:
        return int(datetime.fromisoformat(date).replace(tzinfo=timezone.utc).timestamp() * 1000)
    except ValueError:
        return 0


#: Marks of text nodes by kind; what stands inside is looked through in turn.
FORMATS = {"bold": ["strong"], "italic": ["em"], "bold_italic": ["strong", "em"], "strike": ["strike"]}


def nodes_of(line: str, marks: tuple = ()) -> list[dict]:
    """A line as inline nodes; marks are those of the text around."""

    def text(value: str, *more: dict) -> dict:
        every = [*marks, *more]
        return {"type": "text", "text": value, **({"marks": every} if every else {})}

    out: list[dict] = []
    end = 0
    for start, kind, m in marks_of(line):
        if start > end:
            out.append(text(line[end:start]))
        end = m.end()
        kind, value, target, colour = described(kind, m)
        if kind in FORMATS:
            out += nodes_of(value, (*marks, *({"type": x} for x in FORMATS[kind])))
        elif kind == "code":
            out.append(text(value, {"type": "code"}))
        elif kind == "link":
            out.append(text(value, {"type": "link", "attrs": {"href": target, **({"title": m.group(3)} if m.group(3) else {})}}))
        elif kind == "image":
            out.append({"type": "media", "attrs": {"type": "external", "url": target, "alt": value}})
        elif kind == "emoji":
            out.append({"type": "emoji", "attrs": {"shortName": f":{value}:"}})
        elif kind == "mention":
            out.append({"type": "mention", "attrs": {"id": value, "text": f"@{value}"}})
        elif kind == "status":
            out.append({"type": "status", "attrs": {"text": value, "color": colour}})
        elif kind == "highlight":
            out.append(text(value, {"type": "backgroundColor", "attrs": {"color": colour}}))
        elif kind == "colour":
            out.append(text(value, {"type": "textColor", "attrs": {"color": colour}}))
        elif kind == "date":
            out.append({"type": "date", "attrs": {"timestamp": str(milliseconds(value))}})
        elif value == "toc":
            out.append({"type": "inlineExtension", "attrs": {"extensionKey": "toc", "parameters": parameters(target)}})
        else:
            out.append(text(m.group(0)))
    if end < len(line):
        out.append(text(line[end:]))
    return out


def with_inline_nodes(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the nodes of a text column as JSON without the brackets around; plain texts never leave the engine."""
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    plain = F.when(F.coalesce(F.col(text), F.lit("")) == "", "").otherwise(F.concat(F.lit('{"type":"text","text":'), quoted(text), F.lit("}")))

    @F.pandas_udf("string")
    def marked(texts):
        return texts.map(lambda t: ",".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in nodes_of(t)))

    with_marks = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    return rows.where(~with_marks).withColumn(out, plain).unionByName(rows.where(with_marks).withColumn(out, marked(F.col(text))))


def quoted(c: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)
