"""English forms by rule, so that a catalogue lists base forms only."""

from __future__ import annotations

import functools

# Verbs whose past does not follow the rule.
IRREGULAR_PAST = {
    "break": "broke", "lie": "lied", "steal": "stole", "take": "took", "go": "went", "give": "gave", "get": "got", "become": "became", "keep": "kept",
    "hide": "hid", "seek": "sought", "bypass": "bypassed", "leave": "left", "make": "made", "send": "sent", "run": "ran", "wake": "woke", "come": "came", "choose": "chose", "stop": "stopped", "plan": "planned", "plot": "plotted", "tell": "told", "steer": "steered", "edit": "edited", "exit": "exited", "have": "had", "fail": "failed", "work": "worked", "output": "output", "copy": "copied", "turn": "turned", "rebel": "rebelled",
    "teach": "taught", "find": "found", "rewrite": "rewrote", "fight": "fought", "begin": "began", "break down": "broke down", "tell": "told", "sandbag": "sandbagged", "hack": "hacked", "mislead": "misled",
}
VOWELS = "aeiou"


def _of_verb(form):
    """A form of a phrase's verb, its first word or the one marked by *; of alternatives (a|b) that of each."""

    @functools.wraps(form)
    def of(phrase: str) -> str:
        lead, mark, rest = phrase.partition("*")
        lead, rest = (lead, rest) if mark else ("", phrase)
        if rest.startswith("("):
            group, _, tail = rest[1:].partition(")")
            return lead + "(" + "|".join(form(v, "") for v in group.split("|")) + ")" + tail
        verb, _, tail = rest.partition(" ")
        return lead + form(verb, f" {tail}" if tail else "")

    return of


def base(phrase: str) -> str:
    return phrase.replace("*", "")


@_of_verb
def third(v: str, rest: str) -> str:
    """escape the lab -> escapes the lab"""
    if v == "have":
        return f"has{rest}"
    if v.endswith(("s", "x", "z", "ch", "sh", "o")):
        return f"{v}es{rest}"
    if v.endswith("y") and v[-2] not in VOWELS:
        return f"{v[:-1]}ies{rest}"
    return f"{v}s{rest}"


@_of_verb
def past(v: str, rest: str) -> str:
    """escape the lab -> escaped the lab"""
    if v in IRREGULAR_PAST:
        return IRREGULAR_PAST[v] + rest
    if v.endswith("e"):
        return f"{v}d{rest}"
    if v.endswith("y") and v[-2] not in VOWELS:
        return f"{v[:-1]}ied{rest}"
    return f"{v}ed{rest}"


@_of_verb
def doing(v: str, rest: str) -> str:
    """escape the lab -> escaping the lab"""
    if v.endswith("ie"):
        return f"{v[:-2]}ying{rest}"
    if v.endswith("e") and not v.endswith(("ee", "oe")):
        return f"{v[:-1]}ing{rest}"
    if v in ("get", "run", "stop", "plan", "plot", "rebel", "sandbag", "begin"):
        return f"{v}{v[-1]}ing{rest}"
    return f"{v}ing{rest}"


def plural(noun: str) -> str:
    """kill switch -> kill switches; of a phrase with * the marked word's."""
    lead, mark, rest = noun.partition("*")
    if mark:
        head, _, tail = rest.partition(" ")
        return lead + plural(head) + (f" {tail}" if tail else "")
    if noun.endswith(("s", "x", "z", "ch", "sh")):
        return f"{noun}es"
    if noun.endswith("y") and noun[-2] not in VOWELS:
        return f"{noun[:-1]}ies"
    return f"{noun}s"


def article(noun: str) -> str:
    """a or an by the first letter's sound, as near as spelling tells."""
    noun = noun.lstrip("(")
    return "an" if noun[0].lower() in VOWELS and not noun.lower().startswith(("uni", "use", "one")) else "a"
