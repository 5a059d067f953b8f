"""Text groups of a page, changes over them, undo, and a safe rendering; on the standard library's parser.

The parser gives events in order. What groups need is which text reads on as one paragraph, so a tree
is not built: block tags end a paragraph on entry and exit, closed or not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

from .resources import image_source, resource_url, responsive, usable_source
from .rewrite import Catalogue, Edit, default

# Tags whose text is never changed; those that begin and end a paragraph; those without content; what is removed whole; what is kept.
SKIP = set("script style noscript template textarea select option code pre kbd samp svg math title iframe q blockquote".split())
BLOCK = set("address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr img label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# What marks a part that only a script would open, and what a page's own text stands in.
CLOAKS, DIALOGS, STORY = ("x-cloak", "v-cloak", "ng-cloak", "data-ng-cloak", "popover"), ("dialog", "alertdialog"), ("article", "main")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
REMOVED = set("script style noscript template iframe object embed svg math link meta base".split())
KEPT = set("a abbr article aside b blockquote br caption cite code dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q s samp section small span strong sub summary sup table tbody td tfoot th thead time title tr u ul var html head body".split())
ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "width", "height"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan"}, "time": {"datetime"}, "ol": {"start"}}
BREAK = " "
MINOR = re.compile(r"(?:a|an|the|and|but|or|nor|as|at|by|for|from|in|of|on|per|to|via|vs|with)\Z", re.I)


@dataclass
class Node:
    text: str
    immutable: bool
    tag: str
    at: int = -1


@dataclass
class Group:
    nodes: list[Node] = field(default_factory=list)
    heading: bool = False

    @property
    def text(self) -> str:
        return "".join(n.text for n in self.nodes)


def public_link(value: str, base: str) -> str | None:
    """An absolute http(s) address without credentials, or None."""
    try:
        url = urljoin(base, value.strip())
        parts = urlsplit(url)
        return url if parts.scheme in ("http", "https") and parts.hostname and not parts.username and not parts.password else None
    except ValueError:
        return None


class _Reader(HTMLParser):
    """Events of a page as a list: (kind, tag, attributes or text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, object]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.events += [("start", tag, attrs)] + ([] if tag in VOID else [("end", tag, None)])

    def handle_endtag(self, tag):
        self.events.append(("end", tag, None))

    def handle_data(self, data):
        self.events.append(("text", "", data))


def read(html: str) -> list[tuple[str, str, object]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.events


def groups(html: str | list) -> list[Group]:
    """Paragraphs with editable text. Skipped inline text is immutable context; hidden parts are left out."""
    events = read(html) if isinstance(html, str) else html
    out: list[Group] = []
    now = Group()
    stack: list[tuple[str, bool, bool]] = []  # tag, skipped, hidden

    def done():
        nonlocal now
        if any(not n.immutable and n.text.strip() for n in now.nodes):
            out.append(now)
        now = Group(heading=any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, _, _ in stack))

    for k, (kind, tag, data) in enumerate(events):
        skipped = bool(stack) and stack[-1][1]
        hidden = bool(stack) and stack[-1][2]
        if kind == "start":
            if tag in BLOCK and not (skipped and tag == "br"):
                if tag not in VOID:
                    stack.append((tag, skipped or tag in SKIP, hidden or any(a == "hidden" for a, _ in data)))
                done()
            elif tag == "br":
                now.nodes.append(Node(BREAK, True, "br"))
            elif tag not in VOID:
                stack.append((tag, skipped or tag in SKIP, hidden or tag in REMOVED or tag == "title" or any(a == "hidden" for a, _ in data)))
                if tag == "q" and not hidden:
                    now.nodes.append(Node("“", True, "q"))
        elif kind == "end":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                if tag == "q" and not hidden:
                    now.nodes.append(Node("”", True, "q"))
                del stack[at:]
            if tag in BLOCK:
                done()
        elif not hidden:
            now.nodes.append(Node(data, skipped, stack[-1][0] if stack else "", k))
    done()
    return out


def title_cased(heading: str, edits: list[Edit]) -> list[Edit]:
    """Changes of a heading in title case are put in title case."""
    major = [w for w in re.findall(r"[A-Za-z][A-Za-z'’‐-―-]*", heading) if not MINOR.match(w)]
    if len(major) < 2 or not all(w[0].isupper() for w in major):
        return edits
    return [e._replace(text=re.sub(r"\b[a-z][a-z'’]*", lambda m: m.group() if MINOR.match(m.group()) else m.group()[0].upper() + m.group()[1:], e.text)) for e in edits]


def group_edits(group: Group, catalogue: Catalogue | None = None) -> list[Edit]:
    """The rules' changes of a group that touch editable text only."""
    found, _ = (catalogue or default()).edits(group.text, heading=group.heading)
    if group.heading:
        found = title_cased(group.text, found)
    spans, at = [], 0
    for n in group.nodes if found else ():
        if n.immutable and n.text:
            spans.append((at, at + len(n.text)))
        at += len(n.text)
    # Spans do not overlap: only the last that begins before a change's end may meet it.
    def meets(e: Edit) -> bool:
        k = bisect_left(spans, (max(e.end, e.start + 1), 0)) - 1
        return k >= 0 and spans[k][1] > e.start

    return [e for e in found if not meets(e)]


def popups(events: list) -> set[int]:
    """Start events of parts that stay shut without scripts: dialogs and the like, unless they hold the story or most of the page's text.

    Sizes are differences of running sums, so nested candidates cost nothing more.
    """
    text = list(accumulate((len(re.sub(r"\s+", "", d)) if k == "text" else 0 for k, _, d in events), initial=0))

    def roles(data) -> list[str]:
        return next(((v or "").lower().split() for a, v in data if a == "role"), [])

    story = list(accumulate((k == "start" and (t in STORY or "main" in roles(d)) for k, t, d in events), initial=0))
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for k, (kind, tag, _) in enumerate(events):
        if kind == "start" and tag not in VOID:
            stack.append((tag, k))
        elif kind == "end" and any(t == tag for t, _ in stack[-64:]):
            while True:
                t, start = stack.pop()
                ends[start] = k
                if t == tag:
                    break
    out = set()
    for k, (kind, tag, data) in enumerate(events):
        if kind != "start" or tag in ("html", "body"):
            continue
        names = {a for a, _ in data}
        shut = (tag == "dialog" and "open" not in names) or names & set(CLOAKS) or set(roles(data)) & set(DIALOGS) or any(a == "aria-modal" and (v or "").lower() == "true" for a, v in data)
        if shut:
            end = ends.get(k, len(events) - 1)
            if story[end + 1] == story[k] and 2 * (text[end + 1] - text[k]) <= text[-1]:
                out.add(k)
    return out


def without(events: list, gone: set[int]) -> list:
    """Events without the elements that begin at the given places."""
    if not gone:
        return events
    out, depth, tag_gone = [], 0, ""
    for k, (kind, tag, data) in enumerate(events):
        if depth:
            depth += (kind == "start" and tag == tag_gone and tag not in VOID) - (kind == "end" and tag == tag_gone)
        elif k in gone:
            depth, tag_gone = 1, tag
        else:
            out.append((kind, tag, data))
    return out


def mark(e: Edit) -> str:
    was = escape(e.original, quote=True)
    return f'<mark class="dd" data-was="{was}">{escape(e.text)}</mark>' if e.text else f'<del class="dd" data-was="{was}"></del>'


def render(html: str, base: str, catalogue: Catalogue | None = None) -> tuple[str, str, int]:
    """A page made safe with marked changes: html, its title rewritten, and how many changes were made.

    A change over several text nodes stands in the first; its part of the others is taken out.
    """
    catalogue = catalogue or default()
    events = read(html)
    events = without(events, popups(events))
    pictures: list[str | None] = []  # of each open picture, its first source that applies everywhere
    pieces: dict[int, list[tuple[int, int, str]]] = {}
    changed = 0
    for group in groups(events):
        edits = group_edits(group, catalogue)
        starts = list(accumulate((len(n.text) for n in group.nodes), initial=0)) if edits else []
        for e in edits:
            changed += 1
            first = True
            k = max(0, bisect_right(starts, e.start, hi=len(group.nodes)) - 1)
            while k < len(group.nodes) and starts[k] < max(e.end, e.start + 1):
                n, at = group.nodes[k], starts[k]
                a, b = max(e.start, at), min(e.end, at + len(n.text))
                if (a < b or e.start == e.end == at) and n.at >= 0:
                    pieces.setdefault(n.at, []).append((a - at, b - at, mark(e) if first else ""))
                    first = False
                k += 1
    out, gone, title, in_title = [], [], [], False
    for k, (kind, tag, data) in enumerate(events):
        if kind == "start" and tag in REMOVED:
            if tag not in VOID:
                gone.append(tag)
        elif kind == "end" and gone and tag == gone[-1]:
            gone.pop()
        elif gone:
            continue
        elif kind == "start":
            in_title = in_title or tag == "title"
            if tag == "picture":
                pictures.append(None)
            elif tag == "source" and pictures and not pictures[-1] and usable_source(dict(data)):
                pictures[-1] = responsive(dict(data), False)
            elif tag == "img":
                data = [(a, v) for a, v in data if a != "src"] + [("src", image_source(dict(data), pictures[-1] if pictures else None))]
            if tag in KEPT:
                kept = []
                for a, v in data:
                    if a not in ATTRIBUTES.get(tag, ()):
                        continue
                    if a in ("href", "src"):
                        v = public_link(v or "", base) or ("#" if (v or "").startswith("#") else None)
                    if v is not None:
                        kept.append(f' {a}="{escape(v, quote=True)}"')
                out.append(f"<{tag}{''.join(kept)}>")
        elif kind == "end":
            in_title = in_title and tag != "title"
            if tag == "picture" and pictures:
                pictures.pop()
            if tag in KEPT and tag not in VOID:
                out.append(f"</{tag}>")
        elif in_title:
            title.append(data)
            out.append(escape(catalogue.rewrite(re.sub(r"\s+", " ", data).strip()), quote=False))
        else:
            at, text = 0, []
            for a, b, new in sorted(pieces.get(k, ())):
                text += [escape(data[at:a], quote=False), new]
                at = b
            out.append("".join(text) + escape(data[at:], quote=False))
    return "".join(out), catalogue.rewrite(re.sub(r"\s+", " ", "".join(title)).strip()), changed


MARKED = re.compile(r'<mark class="dd" data-was="([^"]*)">[^<]*</mark>|<del class="dd" data-was="([^"]*)"></del>')


def undo(html: str) -> str:
    """A rendering without its changes."""
    from html import unescape

    return MARKED.sub(lambda m: escape(unescape(m.group(1) if m.group(1) is not None else m.group(2)), quote=False), html)


def article(html: str) -> list[tuple[str, str]]:
    """(type, text) of a page's blocks: heading, item, quote or paragraph, inside article or main where there is one."""
    events = read(html)
    scope = next((t for t in ("article", "main") if any(k == "start" and tag == t for k, tag, _ in events)), None)
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    text: list[str] = []

    def done():
        own = re.sub(r"\s+", " ", "".join(text)).strip()
        text.clear()
        if own and (scope is None or scope in stack):
            kind = "quote" if "blockquote" in stack else "heading" if any(re.fullmatch("h[1-6]", t) for t in stack) else "item" if "li" in stack else "paragraph"
            out.append((kind, own))

    for kind, tag, data in events:
        if kind == "text":
            if not any(t in REMOVED or t in ("title", "nav", "footer") for t in stack):
                text.append(data)
            continue
        if tag in BLOCK:
            done()
        if kind == "start" and tag not in VOID:
            if tag == "p" and "p" in stack:
                del stack[len(stack) - 1 - stack[::-1].index("p") :]
            stack.append(tag)
        elif kind == "end" and tag in stack:
            del stack[len(stack) - 1 - stack[::-1].index(tag) :]
    done()
    return out


CSS_URL = re.compile(r"url\(\s*(['\"]?)([^'\")]*)\1\s*\)", re.I)


def rewrite_css(css: str, base: str) -> str:
    """Addresses in a style sheet made absolute; those that are not public are emptied."""
    return CSS_URL.sub(lambda m: m.group(0) if m.group(2).startswith("#") else f'url("{public_link(m.group(2), base) or ""}")', css)


def proxied_css(css: str, base: str) -> str:
    """Addresses in a style sheet as resource_url gives them, imports by string too; safe inside a style element."""
    css = re.sub(r"(@import\s+)(['\"])([^'\"]*)\2", lambda m: f'{m.group(1)}"{resource_url(m.group(3), base)}"', css, flags=re.I)
    return CSS_URL.sub(lambda m: f'url("{resource_url(m.group(2), base)}")', css).replace("<", "\\3c ")
