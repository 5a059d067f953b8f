"""Who acts: a matcher over the words to the left of a phrase, which walks back to the subject of its clause."""

from __future__ import annotations

import re

from . import lexicon as lx

TOKEN = re.compile(r"\w+(?:[.'’-]\w+)*|[^\w\s]", re.A)


def words(text: str) -> list[str]:
    """Lower-cased words and single marks; the stop of A.I. belongs to it."""
    out: list[str] = []
    for m in TOKEN.finditer(text):
        if not (m.group() == "." and out and out[-1] == "a.i"):
            out.append(m.group().lower())
    return out


def is_filler(w: str) -> bool:
    return w in lx.BETWEEN or (len(w) > 2 and w.endswith("ly")) or w.endswith(("n't", "n’t"))


def is_name(w: str) -> bool:
    return w in lx.NAMES or bool(lx.VERSIONED.match(w))


def back(t: list[str], i: int, most: int = 4) -> int:
    """The place before up to `most` fillers that end at i."""
    while most and i >= 0 and is_filler(t[i]):
        i, most = i - 1, most - 1
    return i


def subject(t: list[str], i: int, generic: bool = True, versions: bool = False) -> int:
    """Where software that ends at i begins, or -1. generic: agents and systems count as they are. versions: tiers and numbers may follow the name."""
    if versions:
        k = 3
        while k and i > 0 and (t[i] in lx.TIERS or t[i][0].isdigit()):
            i, k = i - 1, k - 1
    if i < 0:
        return -1
    w, before = t[i], t[i - 1] if i else ""
    if (before, w) in lx.PAIRS:
        start = i - 1
    elif is_name(w):
        start = i
    elif w in lx.HEADS and (before in ("ai", "ais")):
        start = i - 1
    elif w in lx.HEADS and (generic or w in ("model", "models")):
        start = i
    else:
        return -1
    return -1 if start and t[start - 1] in ("about", "regarding") else start


def acts(t: list[str]) -> bool:
    """An AI does it: software and up to four fillers stand before."""
    return subject(t, back(t, len(t) - 1)) >= 0


def has(t: list[str], many: bool = False, leads: bool = False, free: bool = False) -> bool:
    """Software has, shows or does it: up to eight fillers and bridging words stand after explicit software, or it is software's own.

    many: only if it is in the plural. leads: only if it opens its clause; free: what is before the
    words seen is a beginning.
    """
    i, left = len(t) - 1, 8
    if i >= 0 and not many and not leads and t[i].endswith(("'s", "’s")) and subject([*t[:i], t[i][:-2]], i, False, True) >= 0:
        return True
    while i >= 0:
        start = subject(t, i, False, True)
        if start >= 0:
            return (not many or t[i].endswith("s")) and (not leads or _opens(t, start, free))
        if not left or not (is_filler(t[i]) or t[i] in lx.BRIDGE):
            return False
        i, left = i - 1, left - 1
    return False


def _opens(t: list[str], start: int, free: bool) -> bool:
    """Whether a subject at start opens its clause; free: what is before the words seen is a beginning."""
    if start and t[start - 1].endswith(("'s", "’s")):
        start -= 1
    if start and t[start - 1] in lx.DETERMINERS:
        start -= 1
    return (free if not start else t[start - 1] in lx.LEADS or not t[start - 1][0].isalnum())


def later(t: list[str], free: bool, pronoun: bool = False) -> bool:
    """An AI does it in a clause of several verbs: its subject, a verb before, or what ties the clause to it stands before."""
    i = back(t, len(t) - 1)
    if i >= 0 and t[i] in lx.OBSERVED:
        i = back(t, i - 1)
    if subject(t, i, False, True) >= 0:
        return True
    if i >= 0 and t[i] in (",", "and", "or"):
        k = i - 1
        if k >= 0 and t[k] == ",":
            k -= 1
        for _ in range(4):
            if k < 0 or (t[k] in lx.OPENERS and t[k] not in lx.ACT_FORMS) or not t[k][0].isalnum():
                break
            if t[k] in lx.ACT_FORMS and subject(t, back(t, k - 1), False, True) >= 0:
                return True
            if t[k] in lx.ACT_FORMS and k > 1 and t[back(t, k - 1)] in (",", "and") and later(t[:k], free):
                return True
            k -= 1
    if i >= 2 and t[i] == "it" and (resumed(t[: i + 1]) or (pronoun and _studied(t, i))):
        return True
    last = len(t) - 1
    if last >= 0 and (t[last] in lx.LINKS or t[last - 1 : last + 1] in (["instead", "of"], ["rather", "than"])):
        k = last - (1 if t[last] in lx.LINKS else 2)
        for _ in range(13):
            if k < 0:
                return False
            start = subject(t, k, False, True)
            if start >= 0 and _opens(t, start, free):
                return True
            if t[k] in lx.OPENERS or not t[k][0].isalnum():
                return False
            k -= 1
    return False


def _studied(t: list[str], i: int) -> bool:
    """A study of the AI found that it ..."""
    k = i - 1
    if k >= 0 and t[k] == "that":
        k -= 1
    if k < 3 or t[k] not in lx.FOUND or t[k - 1] not in ("that", "which"):
        return False
    start = subject(t, k - 2, False, True)
    return start >= 0 and any(t[j] in ("on", "of", "with") and j and t[j - 1] in lx.STUDIES for j in range(max(0, start - 3), start))


def resumed(t: list[str]) -> bool:
    """`... a chatbot and it (will)`: software that is addressed and then acts, with one act between at most."""
    i = back(t, len(t) - 1)
    if i >= 0 and t[i] in (",", "and", "or"):
        k = i - (2 if i and t[i - 1] == "," else 1)
        if k >= 0 and t[k] in lx.ACT_FORMS:
            i = back(t, k - 1)
    return i >= 2 and t[i] == "it" and t[i - 1] == "and" and subject(t, i - 2, False) >= 0 and t[i - 2] not in ("model", "models")


def addressed(t: list[str]) -> bool:
    """`(the) model to`: what follows names software that is told to do something."""
    i = 0
    if i < len(t) and t[i] in lx.DETERMINERS:
        i += 1
    if i + 1 < len(t) and (t[i] in lx.ADDRESS_LEADS or t[i].endswith(("'s", "’s"))) and t[i + 1] != "to":
        i += 1
    named = i < len(t) and (t[i] in lx.ADDRESSED or t[i].startswith("gpt-") or (t[i] in ("agent", "agents") and i > 0 and t[i - 1] == "ai"))
    return named and i + 1 < len(t) and t[i + 1] == "to"


def meets(t: list[str], wanted: tuple[str, ...]) -> bool:
    """Whether what follows is one of the wanted words after up to two modifiers, and is not led into something."""
    i = 0
    while i < 2 and i < len(t) and t[i] in lx.MODIFIED and t[i] not in wanted:
        i += 1
    return i < len(t) and t[i] in wanted and t[i + 1 : i + 2] != ["into"]


def has_object(t: list[str]) -> bool:
    return bool(t) and t[0][0].isalnum() and t[0] not in lx.NO_OBJECT and not t[0].endswith("ly")


def qualified(t: list[str]) -> bool:
    """Whether words before a role make it software's: an AI's name, perhaps joined (AI-powered), and up to four modifiers."""
    i = len(t) - 1
    most = 4
    while i >= 0 and most and t[i] in lx.MODIFIERS:
        i, most = i - 1, most - 1
    own = t[i + 1 :]
    if i < 0:
        return False
    joined = False
    if t[i] == "driven" and i:
        i, joined = i - 1, True
    head, _, tail = t[i].rpartition("-")
    if head and tail in lx.JOINED:
        joined, name = True, head
    else:
        name = t[i]
    if name not in ("ai", "a.i", "agi", "llm", "llms") and not (name == "intelligence" and i and t[i - 1] == "artificial"):
        return False
    return joined or not set(own) & lx.VERBAL


def claims(t: list[str]) -> bool:
    """Whether a sentence begins with a claim about software: up to two markers, a determiner with up to three qualifiers, and software."""
    i = 0
    for _ in range(2):
        if i < len(t) and t[i] in lx.MARKERS:
            i += 1
            if i < len(t) and t[i] == ",":
                i += 1
    last = i
    if i < len(t) and t[i] in lx.DETERMINERS:
        last, i = i + 4, i + 1
    for k in range(i, min(len(t), last + 1)):
        for end in (k, k + 1):
            if end < len(t) and subject(t[i : end + 1], end - i, False) == k - i:
                return True
        if not t[k][0].isalnum():
            return False
    return False
