"""Nested wiki markup (templates, tables, links) folded away in one pass.

The markup nests without limit, so no regular expression removes it.  One
sweep over the brackets keeps a stack of what is open; every piece of text is
moved once per level that it survives.  Spark distributes the pages; the
kernel is a small helper on an Arrow batch of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import WIKI_DROP_NAMESPACES

# A table's brackets count at the start of a line only ("{{a|}}" ends no table).
BRACKETS = re.compile(r"(\{\{|\}\}|\[\[|\]\]|^[ \t:]*\{\||^[ \t]*\|\}(?!\}))", re.M)
_CLOSES = {"}}": "{{", "]]": "[[", "|}": "{|"}


def link_text(body: str, drop: frozenset) -> str:
    """What a link shows: its label, or its target; nothing for a dropped namespace."""
    target, bar, label = body.partition("|")
    space, colon, _ = target.partition(":")
    if colon and space.strip().lower() in drop:
        return ""
    target = target[1:] if target.startswith(":") else target
    return label if bar and label else target


def fold(text: str, drop: frozenset) -> str:
    """``text`` without templates and tables, links as their text.  A bracket
    without a partner stays as it is; a closing one closes the nearest open
    bracket of its kind, and those opened in between lose their meaning."""
    out: list[str] = []
    frames: list[tuple[str, str, list[str]]] = []      # kind, bracket as written, parts
    waiting = {"{{": 0, "[[": 0, "{|": 0}
    for i, piece in enumerate(BRACKETS.split(text)):
        here = frames[-1][2] if frames else out
        kind = piece.strip(" \t:") if i % 2 else ""
        if kind in waiting:
            frames.append((kind, piece, []))
            waiting[kind] += 1
        elif kind in _CLOSES and waiting[_CLOSES[kind]]:
            at = len(frames) - 1
            while frames[at][0] != _CLOSES[kind]:
                at -= 1
            closed, frames[at:] = frames[at:], []
            for opened, _, _ in closed:
                waiting[opened] -= 1
            if kind == "]]":
                body = closed[0][2] + [x for _, written, parts in closed[1:] for x in (written, *parts)]
                (frames[-1][2] if frames else out).append(link_text("".join(body), drop))
        else:
            here.append(piece)
    for _, written, parts in frames:
        out.append(written)
        out.extend(parts)
    return "".join(out)


def fold_markup(text: Column, drop=WIKI_DROP_NAMESPACES) -> Column:
    """``fold`` of a text column; null stays null."""
    dropped = frozenset(x.lower() for x in drop)

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: fold(t, dropped), na_action="ignore")
    return folded(text)
