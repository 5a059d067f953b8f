"""Ordered rewriting of one text with a record of every change.

All places where a rule's phrase stands as whole words outside protected spans are found first; they
are then taken by priority of the rule and by place, and one is dropped where it overlaps one taken
before. So the first rule wins, and what is rewritten is not rewritten again. A rule's context is
looked for in the original words to the left, back to the last protected span, and to the right up to
the next change.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, insort
from typing import NamedTuple

from . import clauses, lexicon as lx
from .lexicon import ABOUT, AI_LONG, AI_SHORT, FLAGS, WS
from .protect import MOST_SPANS, protected
from .rules import Rule, builtin

WORDS = re.compile(r"[A-Za-z]+")
#: Contexts that need a word of software in the text.
TIED = {"actor", "clause", "addressed", "action", "software", "softwares", "leading", "resumed", "near"}


def pattern_of(rule: Rule) -> str:
    """A regular expression of a rule's phrase."""
    if not rule.template:
        return re.escape(rule.phrase).replace(r"\ ", f"{WS}+").replace("'", "['’]")
    out, k, text = [], 0, rule.phrase
    while k < len(text):
        c = text[k]
        if c == "]" and text[k + 1 : k + 2] == " ":
            out.append(f"{WS}+)?")
            k += 1
        else:
            out.append({"(": "(?:", "[": "(?:", "{": "(", ")": ")", "}": ")", "]": ")?", "|": "|", " ": f"{WS}+", "~": f"(?:{WS}+|-)", "'": "['’]"}.get(c) or re.escape(c))
        k += 1
    return "".join(out)


def required_words(rule: Rule) -> frozenset[str]:
    """Words of which one stands in any text that the rule matches: a word of the phrase, or the alternatives of a group, whichever are longer; none if there are none."""
    text = rule.phrase.lower()
    if not rule.template:
        return frozenset([max(WORDS.findall(text), key=len, default="")]) - {""}
    choices, depth, part = [], 0, ""
    for c in text + " ":
        if c in "([{":
            if not depth:
                choices += [{w} for w in WORDS.findall(part)]
                part = ""
            depth += 1
            part += c
        elif c in ")]}":
            depth -= 1
            part += c
            if not depth:
                own = part[1:-1]
                if part[0] != "[" and not re.search(r"[(\[{]", own):
                    choices.append({max(WORDS.findall(x), key=len, default="") for x in own.split("|")})
                part = ""
        else:
            part += c
    choices += [{w} for w in WORDS.findall(part)]
    best = max(choices, key=lambda x: min(map(len, x)), default=set())
    return frozenset(best) if "" not in best else frozenset()


#: What a match at the beginning of a sentence follows.
OPENS = re.compile(r"(?:\A|[.!?\u2029])[\s\"'“‘(]*\Z")


class Segment(NamedTuple):
    """original is None where nothing changed; an empty original marks an insertion."""

    text: str
    original: str | None
    protected: bool


class Edit(NamedTuple):
    start: int
    end: int
    text: str
    original: str


def carry_case(original: str, replacement: str, opens: bool = True, proper: bool = False) -> str:
    """All capitals if the original is, else its first letter's case. opens: whether a sentence begins here; elsewhere the capitals of an acronym, or of a word that always has one (proper), say nothing of the case."""
    letters = re.sub(r"[^A-Za-z]", "", original)
    if len(letters) > 1 and letters.isupper():
        return replacement.upper()
    first = WORDS.match(original)
    if not opens and (proper or (first and len(first.group()) > 1 and first.group()[:2].isupper())):
        return replacement
    if original[:1] != original[:1].lower():
        return replacement[:1].upper() + replacement[1:]
    return replacement


class Catalogue:
    """Compiled rules: by required word, the rules that can match a text with it."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_word: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            for word in required_words(rule) or {""}:
                self.by_word.setdefault(word, []).append(k)
        actions = sorted({pattern_of(r) for r in rules if r.context in ("actor", "clause", "resumed")}, key=len, reverse=True)
        self.acts = re.compile("(?:" + "|".join([*actions, rf"(?:is|was|are|were){WS}+misaligned"]) + r")(?![\w-])", FLAGS) if actions else None

    @functools.lru_cache(maxsize=4096)  # noqa: B019  one catalogue lives as long as its worker
    def pattern(self, k: int) -> re.Pattern:
        return re.compile(rf"(?<![\w-])(?:{pattern_of(self.rules[k])})(?![\w-])", FLAGS)

    def required_words(self) -> list[str]:
        """Of any text that a rule changes, one stands in it; empty if some rule requires none."""
        return [] if "" in self.by_word else sorted(self.by_word)

    def free_words(self) -> list[str]:
        """Of any text that a rule changes without a word of software in it, one stands in it; those of rules without a required word are not among them."""
        return sorted(w for w, own in self.by_word.items() if w and any(self.rules[k].context not in TIED for k in own))

    def candidates(self, text: str, indexed: bool = True) -> list[int]:
        if not indexed:
            return list(range(len(self.rules)))
        found = set(self.by_word.get("", ()))
        for word in set(WORDS.findall(text.lower())):
            found.update(self.by_word.get(word, ()))
        return sorted(found)

    def edits(self, text: str, heading: bool = False, indexed: bool = True) -> tuple[list[Edit], list[tuple[int, int]]]:
        """Changes in order, and the protected spans."""
        kept = protected(text, self.acts, self.frames)
        if kept is None:
            return [], [(0, len(text))]
        starts = [a for a, _ in kept]

        def run(k: int) -> tuple[int, int]:
            """The unprotected run around place k, or an empty one."""
            at = bisect_left(starts, k + 1)
            low = kept[at - 1][1] if at else 0
            return low, kept[at][0] if at < len(kept) else len(text)

        taken: list[tuple[int, int, str]] = []
        about = ABOUT.search(text) is not None
        for k in self.candidates(text, indexed):
            rule = self.rules[k]
            if rule.context in TIED and not about:
                continue
            for m in self.pattern(k).finditer(text):
                low, high = run(m.start())
                if m.start() < low or m.end() > high:
                    continue
                at = bisect_left(taken, (m.start(),))
                if (at and taken[at - 1][1] > m.start()) or (at < len(taken) and taken[at][0] < m.end()):
                    continue
                if not self._fits(rule, text, low, m.start(), m.end(), min(high, taken[at][0] if at < len(taken) else high), heading):
                    continue
                plain = rule.replacement.replace("{}", m.group(1)) if m.re.groups else rule.replacement
                insort(taken, (m.start(), m.end(), carry_case(m.group(), plain, OPENS.search(text, max(0, m.start() - 8), m.start()) is not None, rule.phrase[:1].isupper() and not rule.phrase[:2].isupper())))
        if 2 * len(taken) + len(kept) > MOST_SPANS:
            return [], [(0, len(text))]
        return [Edit(a, b, t, text[a:b]) for a, b, t in taken], kept

    def _fits(self, rule: Rule, text: str, low: int, start: int, end: int, high: int, heading: bool) -> bool:
        """Whether the words beside a match are what its rule needs."""
        if rule.ahead and not re.compile(rf"{WS}+" + rule.ahead.replace(" ", f"{WS}+") + r"\s*(?:[?:.!]|\Z)", FLAGS).match(text, end, high):
            return False
        if rule.unless or rule.then or rule.whom or rule.context in ("addressed", "action"):
            right = clauses.words(text[end : min(high, end + 160)])
            if right[:1] and right[0] in rule.unless:
                return False
            if rule.then and not clauses.meets(right, rule.then):
                return False
            if rule.whom and not clauses.has_object(right):
                return False
            if rule.context == "addressed" and not clauses.addressed(right):
                return False
            if rule.context == "action" and not (right and right[0][0].isalnum()):
                return False
        context = rule.context
        if context == "near" and not rule.after:
            return ABOUT.search(text, max(low, start - lx.NEAR), start) is not None or ABOUT.search(text, end, min(len(text), end + lx.NEAR)) is not None
        if context == "opening":
            return not text[:start].strip() and (not text[end:].strip() or text[end : end + 1] in ":.!?")
        if context == "heading":
            return heading
        if context in TIED or rule.after:
            begin = max(low, start - lx.REACH)
            left = clauses.words(text[begin:start])
            if rule.after and (not left or left[-1] not in rule.after):
                return False
            if context in ("actor", "action"):
                return clauses.acts(left)
            free = begin == 0 or begin == low or not text[max(0, begin - 2) : begin].strip()
            if context == "clause":
                return clauses.later(left, free, True)
            if context in ("software", "softwares", "leading"):
                return clauses.has(left, context == "softwares", context == "leading", free)
            if context == "resumed":
                return clauses.resumed(left)
        return True

    def segments(self, text: str, heading: bool = False, indexed: bool = True) -> list[Segment]:
        """The text in pieces: joined they are the rewritten text, with originals for changed ones the text itself."""
        edits, kept = self.edits(text, heading, indexed)
        marks = sorted([(e.start, e.end, Segment(e.text, e.original, False)) for e in edits] + [(a, b, Segment(text[a:b], None, True)) for a, b in kept if a < b], key=lambda x: x[:2])
        out, at = [], 0
        for a, b, segment in marks:
            if at < a:
                out.append(Segment(text[at:a], None, False))
            out.append(segment)
            at = b
        if at < len(text):
            out.append(Segment(text[at:], None, False))
        return out

    def frames(self, words: str) -> bool:
        """Whether some words of a sentence hold a phrase of a rule."""
        return any(self.pattern(k).search(words) for k in self.candidates(words) if self.rules[k].context == "any")

    def rewrite(self, text: str, heading: bool = False) -> str:
        return "".join(s.text for s in self.segments(text, heading))

    def changes(self, text: str) -> bool:
        return bool(self.edits(text)[0])


@functools.lru_cache(maxsize=1)
def default() -> Catalogue:
    return Catalogue(builtin())


def mentions_ai(text: str) -> bool:
    return bool(AI_SHORT.search(text) or AI_LONG.search(text))
