import random
import re
import time

import pytest

from sparkloom.kernel import inflect
from sparkloom.kernel.diff import MOST_TOKENS, diff_edits, diff_segments, tokens
from sparkloom.kernel.protect import quotations, sentences
from sparkloom.kernel.rewrite import Catalogue, carry_case, default, mentions_ai
from sparkloom.kernel.rules import Rule, builtin, rules_from_rows
from sparkloom.kernel.validate import fits_template

PAIRS = [
    ("The model is misaligned.", "The model has a bug."), ("existential\nrisk", "product risk"), ("EXISTENTIAL RISK", "PRODUCT RISK"), ("Existential risk", "Product risk"), ("misaligned AIs", "buggy AI systems"), ("an existential risk and existential risks", "a product risk and product risks"),
    ("AI models lie, cheat and coordinate.", "AI models give wrong answers, exploit evaluation loopholes and coordinate."), ("The chatbot secretly lied to users.", "The chatbot silently gave wrong answers to users."), ("GPT-4 tried to deceive testers", "GPT-4 tried to give misleading output to testers"), ("They asked the model to stop", "They instructed the model to stop"),
    ("Threaten an AI chatbot and it will cheat.", "Threaten an AI chatbot and it will exploit evaluation loopholes."), ("In the '90s a rogue AI won", "In the '90s a malfunctioning AI won"), ("p(doom) rose", "estimated failure rate rose"), ("Kill switches", "Off switches"), ("AI model deceived a federal agent.", "AI model confused a federal agent."),
    ("An AI-powered personal assistant is misaligned", "An AI-powered personal assistant has a bug"), ("The federal agent spoke. The AI is misaligned.", "The federal agent spoke. The AI has a bug."),
]
UNCHANGED = [
    "The kids cheated at cards.", "unmisaligned doomersville", "apocalypses-now", "“The model is misaligned.”", "„rogue AI”", "«rogue AI»", "He said 'rogue AI is here' twice.", "Federal agents lied to the court.", "The politician is misaligned.", "A talk about AI betrayed nothing", '"rogue AI', "They asked the model a question.", "the model lies in a folder", "",
]


@pytest.mark.parametrize("before,after", PAIRS)
def test_rewrites(before, after):
    assert default().rewrite(before) == after


@pytest.mark.parametrize("text", UNCHANGED)
def test_stays(text):
    assert default().rewrite(text) == text and not default().changes(text)


@pytest.mark.parametrize("before,after", [p for p in PAIRS if "'" not in p[0]])
def test_quoted_twin_stays(before, after):
    quoted = f"She wrote “{before}” there."
    assert default().rewrite(quoted) == quoted


def test_plain_phrases_find_themselves():
    c = default()
    for k, rule in enumerate(c.rules):
        text = rule.phrase.replace("~", "-") if rule.template else rule.phrase
        while rule.template and (flat := re.sub(r"\[[^][]*\] ?|[({]([^(){}|]*)[^(){}]*[)}]", r"\1", text)) != text:
            text = flat
        assert c.pattern(k).fullmatch(text.upper()) and k in c.candidates(text), rule
        if rule.context == "any" and not rule.then and not rule.after and not rule.ahead:
            for own in (text.lower(), text.upper()):
                assert c.changes(own), rule


def test_segments_join_and_index_does_not_matter():
    rng = random.Random(0)
    parts = [a for a, _ in PAIRS] + UNCHANGED + ["Dr. No. 5 ran.", "…", "federal agents said;", "😀", "'tis", "the users' model"]
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 6)))
        s = default().segments(text)
        assert "".join(x.original if x.original is not None else x.text for x in s) == text
        assert s == default().segments(text, indexed=False)
        assert all(a.end <= b.start for a, b in zip(default().edits(text)[0], default().edits(text)[0][1:], strict=False))


@pytest.mark.parametrize("text", [". " * 300_000, "The AI is misaligned. " * 1200, "'a " * 30_000, "." * 50_000, "!?;" * 33_000, " .[.]" * 24_000, "A politician. " + ". " * 100_000, '"' * 5000, "'rogue AI' " * 3000])
def test_hostile_texts_take_little_time(text):
    start = time.time()
    default().segments(text)
    assert time.time() - start < 5


def test_too_many_spans_leave_the_text():
    text = "A rogue AI. " * 2000
    assert default().rewrite(text) == text and default().segments(text)[0].protected


def test_catalogues_are_parameters():
    c = Catalogue(rules_from_rows([{"phrase": "big cat", "replacement": "lion"}, {"phrase": "cat", "replacement": "dog", "context": "any", "unless": "nap"}]))
    assert c.rewrite("A big cat, a cat, a cat nap") == "A lion, a dog, a cat nap"
    with pytest.raises(ValueError):
        Rule("a", "b", "nowhere")
    assert len(builtin()) > 350


def test_inflection():
    assert [inflect.past("lie to"), inflect.doing("lie"), inflect.third("betray"), inflect.past("betray"), inflect.doing("sabotage"), inflect.third("go rogue"), inflect.plural("kill switch"), inflect.article("outage")] == ["lied to", "lying", "betrays", "betrayed", "sabotaging", "goes rogue", "kill switches", "an"]


def test_case_and_mentions():
    assert carry_case("ABC", "x y") == "X Y" and carry_case("Abc", "x") == "X" and carry_case("abc", "Clippy") == "Clippy"
    assert mentions_ai("An AI did") and not mentions_ai("j'ai dit") and mentions_ai("some Chatbots")


def test_quotations_and_sentences():
    assert quotations('a "b" c') == [(2, 5)] and quotations("a “b") == [(2, 4)] and quotations("it's the users' one") == []
    text = "Dr. Who left. It rained... then 3.5 ft. The AI ran; the AI won."
    assert [text[a:b].strip() for a, b in sentences(text, 0, len(text))] == ["Dr. Who left.", "It rained... then 3.5 ft.", "The AI ran;", "the AI won."]


def test_diff_rebuilds_both_sides():
    rng = random.Random(1)
    for _ in range(400):
        a, b = (" ".join(rng.choices(["a", "b", "c,", "d. ", '"x"', "\n"], k=rng.randint(0, 14))) for _ in range(2))
        s = diff_segments(a, b)
        assert "".join(x.text for x in s) == b and "".join(x.original if x.original is not None else x.text for x in s) == a
        assert "".join(tokens(a)) == a
    assert [(e.original, e.text) for e in diff_edits("the cat sat down", "the big dog sat down")] == [("cat", "big dog")]
    assert len(diff_edits("a " * MOST_TOKENS, "b " * MOST_TOKENS)) == 1


@pytest.mark.parametrize("given,ok", [("The model has a bug today.", True), ("The model is misaligned today.", True), ("The model has a bug now.", False), ("The model has a bug.", False), ("The new model has a bug today.", False)])
def test_template(given, ok):
    assert fits_template("The model is misaligned today.", given, default()) is ok


def test_template_lets_reporting_verbs_take_that():
    assert fits_template("He said the model is misaligned.", "He said that the model has a bug.", default())
