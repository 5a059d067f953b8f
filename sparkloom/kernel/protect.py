"""Spans of a text that are never rewritten: quotations, and sentences in which people act."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from . import clauses, lexicon as lx
from .lexicon import ABBREVIATIONS, ROLE, WS

#: A text that falls into more spans than this is left as it is.
MOST_SPANS = 1024
# Quotation marks, opening and closing.
PAIRS = {'"': '"', "“": "”", "„": "”", "«": "»"}
# Elided words that begin with an apostrophe.
ELIDED = re.compile(r"(?:twas|tis|twere|twill|twould|em|cause|cos|til|bout)\b", re.I | re.A)
YEAR = re.compile(r"\d\d(?:s?\b)", re.A)
# What introduces speech.
SPEECH = re.compile(rf"(?:[,:]|\b(?:said|says|wrote|writes|told|tells|asked|asks|replied|replies|stated|states|quoted|quotes|reported|reports|report|remarked|claimed|claims|explained|whispered|shouted|noted|added|responded|declared|announced|recounted)){WS}*", re.I | re.A)
NO_STOP = re.compile(rf"\b(?:{'|'.join(ABBREVIATIONS)}|No|[A-Z])\Z", re.A)
#: Closing marks and references that belong to a sentence that has ended, and an ordinal after "No.".
STOP = re.compile(r"[.!?;\u2029]+")
CLOSING = re.compile(r"[)\]}”\"’'»¹²³⁰⁴⁵⁶⁷⁸⁹]+")
# A reference in brackets, by numbers, or by author and year.
REFERENCE = re.compile(r"\[[^\]\r\n]{1,64}\]|\(\d{1,4}(?:\s*[-–,;]\s*\d{1,4})*\)|\([A-Z][^()\r\n\d]{0,48}?,?\s+(?:1[5-9]\d\d|20\d\d)[a-z]?(?:,\s*pp?\.\s*\d+(?:[-–]\d+)?)?\)")
LITERARY = re.compile(rf"\balignment(?:{WS}|-)faking{WS}+occurs{WS}+in{WS}+(?:literature|human{WS}+relationships|politics)\b", re.I)
NUMBERED = re.compile(r"\s*\d")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _single_quotes(text: str) -> dict[int, int]:
    """Openings of speech in single quotes with the last plausible closing mark of each.

    An opening follows no word character and precedes text; a closing one precedes no word character.
    Elided words and years of two digits are no openings unless speech is introduced or a clear closing
    mark, not one that may be a possessive, follows before another opening.
    """
    opens, closes, clear = [], {"'": [], "’": []}, {"'": [], "’": []}
    for k, c in enumerate(text):
        if c in "'‘" and not (k and _word(text[k - 1])) and text[k + 1 :].strip():
            opens.append(k)
        if c in closes and not (k + 1 < len(text) and _word(text[k + 1])):
            closes[c].append(k)
            if k and not text[k - 1].isspace() and text[k - 1] not in "sS":
                clear[c].append(k)
    if not opens:
        return {}
    introduced = {m.end() for m in SPEECH.finditer(text)}
    out = {}
    for n, k in enumerate(opens):
        mark = "'" if text[k] == "'" else "’"
        if not closes[mark] or closes[mark][-1] <= k:
            continue
        rest = text[k + 1 : k + 14].lstrip()
        year = text[k] == "'" and YEAR.match(rest)
        if (year or ELIDED.match(rest)) and k not in introduced:
            at = bisect_right(clear[mark], k)
            if at == len(clear[mark]):
                continue
            following = next((o for o in opens[n + 1 :] if text[o] == text[k]), None)
            if year and text[:k].strip() and following is not None and following < clear[mark][at]:
                continue
        out[k] = closes[mark][-1]
    return out


def quotations(text: str) -> list[tuple[int, int]]:
    """Half-open spans of quotations; one that is not closed reaches to the end."""
    singles = _single_quotes(text) if "'" in text or "‘" in text else {}
    spans, k = [], 0
    marks = [i for i, c in enumerate(text) if c in PAIRS or i in singles]
    at = 0
    while at < len(marks):
        k = marks[at]
        if k in singles:
            end = singles[k] + 1
        else:
            close = text.find(PAIRS[text[k]], k + 1)
            end = close + 1 if close >= 0 else len(text)
        spans.append((k, end))
        at = bisect_left(marks, end)
    return spans


def _claims(text: str, at: int, end: int) -> bool:
    """Whether a new claim about software begins at a place, after references."""
    while (m := REFERENCE.match(text, _past_space(text, at, end), end)):
        at = m.end()
    return clauses.claims(clauses.words(text[at : min(end, at + 160)]))


def _past_space(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Sentences of a span. Abbreviations, initials, numbered "No.", decimals and ellipses end none; a semicolon only before a new claim about software."""
    at = start
    for m in STOP.finditer(text, start, end):
        if m.start() < at:
            continue
        stop, mark = m.end(), m.group()
        while stop < end and (more := CLOSING.match(text, stop, end) or REFERENCE.match(text, stop, end)):
            stop = more.end()
        if stop < end and not text[stop].isspace() and mark[-1] != "\u2029":
            continue
        if mark[0] == "." and len(mark) == 1:
            before = NO_STOP.search(text, max(start, m.start() - 20), m.start())
            if before and not (before.group() == "No" and not NUMBERED.match(text, stop)) and (before.group() in lx.TITLES or len(before.group()) == 1 or not _claims(text, stop, end)):
                continue
        elif mark.startswith(".."):
            continue
        if mark == ";" and not _claims(text, stop, end):
            continue
        yield at, stop
        at = stop
    if at < end:
        yield at, end


def _ends(words: str) -> bool:
    """Whether a sentence ends after its object: marks, references, and adjuncts of time and place only."""
    if len(words) > 256:
        return False
    while (m := re.compile(r"[\s.!?;¹²³⁰⁴⁵⁶⁷⁸⁹)\]}]+").match(words) or REFERENCE.match(words)):
        words = words[m.end() :]
    once, relative, spans, events, places = lx.ADJUNCTS
    t = clauses.words(words)
    i = 0
    while i < len(t):
        if not t[i][0].isalnum():
            if t[i] in ".!?;)]}":
                i += 1
                continue
            return False
        if t[i] in once:
            i += 1
        elif t[i] in relative and t[i + 1 : i + 2] and t[i + 1] in spans:
            i += 2
        elif t[i] in ("in", "during") and t[i + 1 : i + 2] and re.fullmatch(r"\d{4}", t[i + 1]):
            i += 2
        elif t[i] == "at" and t[i + 1 : i + 2] and t[i + 1][0].isdigit():
            i += 2
            while i < len(t) and (t[i] in (":", "am", "pm") or t[i][0].isdigit()):
                i += 1
        elif t[i] == "during" and len(t) > i + 2 and t[i + 1] in ("the", "a") and t[i + 2] in events:
            i += 3
        elif t[i] in ("in", "at", "near") and len(t) > i + 2 and t[i + 1] == "the" and t[i + 2] in places:
            i += 3
        else:
            return False
    return True


def _acted_on(lead: str, acts: re.Pattern | None, frames: Callable[[str], bool]) -> bool:
    """Whether the words before a role say that software acts on the person: software, an act, and what belongs to the object only."""
    m = re.compile(rf"{WS}*(?:(?:the|a|an|this|that|our|your){WS}+)?", re.I).match(lead)
    at = m.end()
    spans = [x.span() for x in clauses.TOKEN.finditer(lead, at)]
    t = [lead[a:b].lower() for a, b in spans]
    end = next((k for k in range(min(3, len(t)), 0, -1) if clauses.subject(t[:k], k - 1) == 0), 0)
    if not end:
        return False
    rest = lead[spans[end - 1][1] :]
    plain = lambda words, most: len(words) <= most and all(w[0].isalnum() and w not in lx.BREAKS for w in words)
    k = end
    for _ in range(10):
        if acts is not None and k < len(t) and (found := acts.match(lead, spans[k][0])):
            bridge = lead[found.end() :]
            return plain(clauses.words(bridge), 8) and not frames(bridge)
        if k < len(t) and (clauses.is_filler(t[k]) or t[k] in lx.OBSERVED):
            k += 1
        else:
            break
    words = clauses.words(rest)
    if len(rest) > 256 or any(w in lx.FRAME_BREAKS or w in ".!?;" for w in words):
        return False
    last = next((k for k in range(len(words) - 1, -1, -1) if words[k] in lx.FRAME_ENDS), None)
    return last is not None and plain(words[last + 1 :], 8) and frames(rest) and not frames(" ".join(words[last + 1 :]))


def has_actor(sentence: str, acts: re.Pattern | None = None, frames: Callable[[str], bool] = lambda words: False) -> bool:
    """Whether a person's role stands in a sentence other than as software's own kind or as the object of its action."""
    if LITERARY.search(sentence):
        return True
    for m in ROLE.finditer(sentence):
        if clauses.qualified(clauses.words(sentence[max(0, m.start() - 256) : m.start()])):
            continue
        if _acted_on(sentence[: m.start()], acts, frames) and _ends(sentence[m.end() :]):
            continue
        return True
    return False


def protected(text: str, acts: re.Pattern | None = None, frames: Callable[[str], bool] = lambda words: False) -> list[tuple[int, int]] | None:
    """All protected spans in order, without overlap; None where the text falls into too many spans.

    acts matches verbs that software may do to a person. A sentence in which a person acts is
    protected; across a quotation inside it the protection goes on to the sentence's end.
    """
    quoted = quotations(text)
    if len(quoted) > MOST_SPANS:
        return None
    if not ROLE.search(text) and not LITERARY.search(text):
        return quoted
    spans, at, carried = [], 0, False
    for a, b in [*quoted, (len(text), len(text))]:
        if at < a:
            for i, (x, y) in enumerate(sentences(text, at, a)):
                if len(spans) + i > MOST_SPANS:
                    return None
                fresh = i == 0 and spans and text[max(0, x - 2)] in ".!?" and _claims(text, x, y)
                hold = (carried and not fresh) or has_actor(text[x:y], acts, frames)
                if hold:
                    spans.append((x, y))
                carried = hold and y == a and not text[x:y].rstrip().endswith((".", "!", "?"))
        if a < b:
            spans.append((a, b))
        at = b
    return spans
