"""Word-level differences of two texts by a longest common subsequence."""

from __future__ import annotations

import re

import numpy as np

from .rewrite import Edit, Segment

#: Texts of more tokens than this on a side are one whole change.
MOST_TOKENS = 1500
TOKEN = re.compile(r"\s+|[.,;:!?\"“”‘’()]|[^\s.,;:!?\"“”‘’()]+")


def tokens(text: str) -> list[str]:
    """Words, whitespace runs and single marks; joined they are the text."""
    return TOKEN.findall(text)


def _steps(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Keep, drop and add steps of a longest common subsequence; of equal ways additions come first."""
    names = {t: k for k, t in enumerate(dict.fromkeys(a + b))}
    x, y = np.array([names[t] for t in a], int), np.array([names[t] for t in b], int)
    # length[i, j]: of the rest of a from i and of b from j. A row is a running maximum from the right.
    length = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.where(x[i] == y, length[i + 1, 1:] + 1, length[i + 1, :-1])
        length[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            out.append(("keep", i, j))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or length[i, j + 1] >= length[i + 1, j]):
            out.append(("add", i, j))
            j += 1
        else:
            out.append(("drop", i, j))
            i += 1
    return out


def diff_edits(before: str, after: str) -> list[Edit]:
    """Changes with offsets into before. Changes that only whitespace parts are one; shared space at a change's ends is left out."""
    if before == after:
        return []
    a, b = tokens(before), tokens(after)
    if len(a) > MOST_TOKENS or len(b) > MOST_TOKENS:
        return [Edit(0, len(before), after, before)]
    changes: list[list] = []  # start, end, text
    at, open_ = 0, False
    for kind, i, j in _steps(a, b):
        if kind == "keep":
            at += len(a[i])
            open_ = False
            continue
        if not open_:
            gap = before[changes[-1][1] : at] if changes else "x"
            if gap and not gap.isspace():
                changes.append([at, at, ""])
            elif changes:
                changes[-1][1] = at
                changes[-1][2] += gap
            open_ = True
        if kind == "drop":
            at += len(a[i])
            changes[-1][1] = at
        else:
            changes[-1][2] += b[j]
    out = []
    for start, end, text in changes:
        old = before[start:end]
        left = len(old) - len(old.lstrip())
        left = left if old[:left] == text[:left] and len(old) > left and len(text) > left else 0
        right = len(old) - len(old.rstrip())
        right = right if right and old[-right:] == text[-right:] and len(old) > left + right and len(text) > left + right else 0
        start, end, text = start + left, end - right, text[left : len(text) - right]
        if before[start:end] != text:
            out.append(Edit(start, end, text, before[start:end]))
    return out


def diff_segments(before: str, after: str) -> list[Segment]:
    """after in pieces, with what stood in before for changed ones: joined texts are after, joined originals before."""
    out, at = [], 0
    for e in diff_edits(before, after):
        if at < e.start:
            out.append(Segment(before[at : e.start], None, False))
        out.append(Segment(e.text, e.original, False))
        at = e.end
    if at < len(before):
        out.append(Segment(before[at:], None, False))
    return out
