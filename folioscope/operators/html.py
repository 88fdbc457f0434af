"""Raw pages to text."""

from __future__ import annotations

import html
import re
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.expr import strip

#: Points of a list level; a redirect in front of an address; the class of an exported list, its level at the end.
MARGIN = 36
REDIRECT = re.compile(r"https?://(?:www\.)?google\.com/url\?")
LIST_CLASS = re.compile(r'class="[^"]*?(lst-kix_[a-z0-9]+)-(\d+)')

_LIST = re.compile(r"<ul[^>]*>.*?</ul>", re.S | re.I)
_ITEM = re.compile(r"<li\b([^>]*)>(.*?)</li>", re.S | re.I)
_MARGIN = re.compile(r"margin-left:\s*(\d+)pt")
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a>""", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
#: Characters that stand for <, > and & until all tags are gone.
_HELD = str.maketrans("<>&", "﷐﷑﷒")


def unwrapped(href: str) -> str:
    """The address behind a redirect, else href."""
    found = parse_qs(urlparse(href).query).get("q") if REDIRECT.match(href) else None
    return found[0] if found else href


def linked(m: re.Match) -> str:
    """A link as [label](address); one without a label goes."""
    label = m.group(3)
    if not re.sub(r"<[^>]*>", "", label).strip():
        return label
    return f"[{label}]({unwrapped(html.unescape(m.group(1) or m.group(2) or ''))})"


def nested(items: list[tuple[int, str]]) -> str:
    """Items with their levels as lines; an item is below the last one of a lower level."""
    out, stack = [], []
    for level, text in items:
        while stack and stack[-1] >= level:
            stack.pop()
        out.append("\t" * len(stack) + "- " + text.strip())
        stack.append(level)
    return "\n\n" + "\n".join(out) + "\n\n"


def with_lists(page: str) -> str:
    """Lists as lines. Lists of one class that follow each other, nothing but space between, are one list, an item's level that of its
    class; in any other list it is that of its margin."""
    found = [(m.start(), m.end(), m.group(0), LIST_CLASS.search(m.group(0)[: m.group(0).find(">") + 1])) for m in _LIST.finditer(page)]
    out, at, i = [], 0, 0
    while i < len(found):
        name, j = found[i][3] and found[i][3].group(1), i + 1
        while name and j < len(found) and found[j][3] and found[j][3].group(1) == name and not page[found[j - 1][1] : found[j][0]].strip():
            j += 1
        items = []
        for _, _, block, kind in found[i:j]:
            for m in _ITEM.finditer(block):
                margin = _MARGIN.search(m.group(1))
                level = int(kind.group(2)) if j - i > 1 else max(0, int(margin.group(1)) // MARGIN - 1) if margin else 0
                items.append((level, m.group(2)))
        out += [page[at : found[i][0]], nested(items) if items else "".join(x[2] for x in found[i:j])]
        at, i = found[j - 1][1], j
    return "".join([*out, page[at:]])


def marked_up(page: str | None) -> str | None:
    """Lists and links as markdown, character references decoded, but for those that would make a tag."""
    if page is None:
        return None
    page = with_lists(_LINK.sub(linked, page))
    return _REFERENCE.sub(lambda m: html.unescape(m.group(0)).translate(_HELD) if html.unescape(m.group(0)) != m.group(0) else m.group(0), page)


@F.pandas_udf(StringType())
def _marked_up(pages: pd.Series) -> pd.Series:
    return pages.map(marked_up, na_action="ignore")


def clean_html(page: Column) -> Column:
    """A page's text, in this order: scripts, styles and head go; lists and links become markdown; blocks end lines; tags go; blank
    lines, line ends, empty links and zero-width characters. Null stays null.

    Only pages with lists, links or references go through Python, for what no built-in function does: levels that depend on the
    items before, addresses inside addresses, and the table of references.
    """
    first = [(r"(?is)<(script|style|head)\b.*?</(script|style|head)>", ""), (r"(?s)<!--.*?-->", "")]
    steps = [
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)</?(p|div|h[1-6]|ul|ol|article|nav|footer|table|tr)\b[^>]*>", "\n\n"), (r"<[^>]*>", ""),
        ("﷐", "<"), ("﷑", ">"), ("﷒", "&"), (r"(?<!!)\[\]\([^)]*\)", ""), ("[​‌﻿]", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in first:
        page = F.regexp_replace(page, pattern, to)
    page = F.when(page.rlike(r"(?i)<ul|<a\s|&"), _marked_up(page)).otherwise(page)
    for pattern, to in steps:
        page = F.regexp_replace(page, pattern, to)
    return strip(page)
