"""Column expressions on text; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as browsers see it; Java's and RE2's own classes know only the ASCII part.
JS_SPACE = r"[\t\n\x{b}\x{c}\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: A blank line between blocks of plain text.
BLANK_LINE = r"\n\s*\n|\r\n\s*\r\n"
# Mentions of AI; short forms as written, long ones in any case.
AI_SHORT = r"(?:^|[^A-Za-z0-9_])(?:AIs?|AGI|LLMs?)(?:[^A-Za-z0-9_]|$)"
AI_LONG = r"(?i)(?:^|[^A-Za-z0-9_])(?:artificial\s+intelligence|chatbots?|language\s+models?|superintelligence|ChatGPT|Claude|Gemini|Grok|Copilot)(?:[^A-Za-z0-9_]|$)"
# Context and hint words that make a text worth a model's look, any case.
CONTEXT_WORDS = (
    "AIs?", "AGI", "LLMs?", "superintelligences?", "artificial[\\s-]+intelligence", "language[\\s-]+models?", "machine[\\s-]+learning", "neural[\\s-]+(?:nets?|networks?)", "chatbots?", "Claude", "ChatGPT", "Gemini", "Grok", "Copilot", "Llama", "models?", "bots?", "agents?", "assistants?", "systems?", "OpenAI", "Anthropic", "DeepMind",
)
HINT_WORDS = (
    "misalign\\w*", "alignment", "extinct\\w*", "doom\\w*", "apocalyp\\w*", "superintellig\\w*", "rogue", "sentien\\w*", "conscious\\w*", "deceiv\\w*", "decept\\w*", "defy\\w*", "defie[sd]", "resist\\w*", "lie[sd]?", "lying", "schem\\w*", "plott\\w*", "takeover", "take over", "catastroph\\w*", "existential", "kill\\w*", "destroy\\w*", "threat\\w*", "escap\\w*", "cheat\\w*",
    "smuggl\\w*", "blackmail\\w*", "manipulat\\w*", "self-preservation", "preserv\\w*", "own kind", "shut ?down", "wants?", "wanted", "decided", "believes?", "believed", "realiz\\w*",
)
AI_CONTEXT = "(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(CONTEXT_WORDS) + ")(?:[^A-Za-z0-9_]|$)"
HINTS = "(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(HINT_WORDS) + ")(?:[^A-Za-z0-9_]|$)"
# Words that a faithful rewrite keeps in order.
INVARIANT_WORDS = (
    "no", "not", "never", "none", "all", "any", "some", "few", "many", "most", "only", "may", "might", "can", "could", "will", "would", "should", "must", "more", "less", "fewer", "higher", "lower", "before", "after", "until", "unless", "if", "except", "without", "likely", "unlikely", "certain", "certainly", "uncertain", "possibly", "possible", "impossible", "always", "usually", "often", "sometimes", "rarely", "seldom", "better", "worse", "greater", "smaller", "because",
)
INVARIANT = r"\b(?:" + "|".join(INVARIANT_WORDS) + r")\b"
NUMBERS = r"\d[\d,.]*\d|\d"
SYMBOLS = r"[$€£¥%+−<>≤≥=]"
QUOTES = r"[\"‘’“”«»„]"
STOPS = r"[.!?…]"


def clean(c: Column) -> Column:
    """Whitespace runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, JS_SPACE + "+", " "))


def blocks(c: Column) -> Column:
    """Cleaned blocks of plain text, empty ones left out, in order."""
    return F.filter(F.transform(F.split(c, BLANK_LINE), clean), lambda b: b != "")


def to_html(title: Column, text: Column) -> Column:
    """A heading and a paragraph for each block."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("<h1>"), escape(title), F.lit("</h1>"))).otherwise("")
    return F.concat(head, F.array_join(F.transform(blocks(text), lambda b: F.concat(F.lit("<p>"), escape(b), F.lit("</p>"))), ""))


def escape(c: Column) -> Column:
    """The five HTML entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def carry_case(original: Column, replacement: Column) -> Column:
    """The replacement in the original's case: all capitals, first capital, or as written."""
    letters = F.regexp_replace(original, "[^A-Za-z]", "")
    first = F.substring(original, 1, 1)
    return F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(replacement)).when(first != F.lower(first), capitalised(replacement)).otherwise(replacement)


def counted(n: Column, word: str) -> Column:
    """1 change, 2 changes"""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(word)).otherwise(F.lit(word + "s")))


def mentions_ai(c: Column) -> Column:
    return c.rlike(AI_SHORT) | c.rlike(AI_LONG)


def needs_model(original: Column, rules_version: Column) -> Column:
    """Changed by rules, or AI and alarm in one text."""
    return (original != rules_version) | (c_both(original))


def c_both(c: Column) -> Column:
    return c.rlike(AI_CONTEXT) & c.rlike(HINTS)


def sample(title: Column, description: Column, body: Column, most: int = 30_000) -> Column:
    return F.concat_ws("\n", title, description, F.substring(body, 1, most))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def clean_model_output(c: Column, original: Column | None = None) -> Column:
    """Without a leading label, and without one pair of wrapping quotes unless the original has one itself."""
    c = F.trim(F.regexp_replace(c, r"^\s*(?i:rewritten(?: paragraph)?|rewrite|output|paragraph)\s*:\s*", ""))
    bare = F.trim(F.regexp_replace(c, r'(?s)^["“](.*)["”]$', "$1"))
    return bare if original is None else F.when(F.trim(original).rlike(r'(?s)^["“].*["”]$'), c).otherwise(bare)


def most_tokens(c: Column) -> Column:
    return (F.ceil(F.length(c) / 2) + 64).cast("int")
