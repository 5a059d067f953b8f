"""Whether a proposed rewrite says what the rules' own rewrite or the original says, token by token."""

from __future__ import annotations

import re

from .protect import quotations
from .rewrite import Catalogue

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|\S")
# Verbs after which a rewrite may put "that".
REPORTING = {"warn", "warned", "say", "said", "says", "report", "reported", "reports", "noted", "notes", "wrote"}


def content_words(text: str) -> list[str]:
    return WORD.findall(text)


def quoted_text(text: str) -> list[str]:
    return [text[a:b] for a, b in quotations(text)]


def accepts(original: str, rewritten: str, catalogue: Catalogue) -> bool:
    """The checks of shape and the word-by-word check on one pair."""
    def listed(pattern: str, text: str) -> list[str]:
        return re.findall(pattern, text)

    if not rewritten or re.search(r"\n\s*\n", rewritten) or not 0.6 <= len(rewritten) / max(1, len(original)) <= 1.7:
        return False
    if [n.rstrip(".,") for n in listed(r"\d[\d,.]*\d|\d", original)] != [n.rstrip(".,") for n in listed(r"\d[\d,.]*\d|\d", rewritten)]:
        return False
    for pattern in (r"[$€£¥%+−<>≤≥=]", r"[\"‘’“”«»„]", r"[.!?…]"):
        if listed(pattern, original) != listed(pattern, rewritten):
            return False
    return quoted_text(original) == quoted_text(rewritten) and fits_template(original, rewritten, catalogue)


def fits_template(original: str, rewritten: str, catalogue: Catalogue) -> bool:
    """Whether rewritten is the original with some of the rules' changes made, and otherwise word for word.

    The original is a row of slots: fixed words, and for each change either its replacement or what
    it replaces. All positions that rewritten may have come to are followed at once.
    """
    slots: list[list[list[str]]] = []
    for s in catalogue.segments(original):
        if s.original is None:
            slots += [[[w]] for w in content_words(s.text)]
        else:
            slots.append([content_words(s.text), content_words(s.original)])
    given = content_words(rewritten)
    places = {0}
    for choices in slots:
        further = set()
        for p in places:
            starts = [p, p + 1] if p and p < len(given) and given[p].lower() == "that" and given[p - 1].lower() in REPORTING else [p]
            for q in starts:
                for words in choices:
                    if [w.lower() for w in given[q : q + len(words)]] == [w.lower() for w in words]:
                        further.add(q + len(words))
        places = further
        if not places:
            return False
    return len(given) in places
