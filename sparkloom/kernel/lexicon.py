"""Word classes that the contexts of rules and the protection of people's sentences are told by."""

from __future__ import annotations

import re

from . import inflect

FLAGS = re.I | re.A
#: Whitespace as browsers see it, which re.A does not know.
SPACES = "\t\n\x0b\x0c\r \xa0  -     　﻿"
WS = f"[{SPACES}]"
#: Earlier characters that a context may look at, and those of a sentence that may mention software.
REACH, NEAR = 400, 240

# Names of software that acts, in one word; pairs of words; words that are software where they act like it.
NAMES = set("ai ais a.i agi llm llms superintelligence superintelligences chatbot chatbots claude chatgpt gemini grok copilot llama deepseek".split())
PAIRS = {("artificial", "intelligence"), ("language", "model"), ("language", "models"), ("machine", "learning"), ("neural", "net"), ("neural", "nets"), ("neural", "network"), ("neural", "networks")}
HEADS = set("model models bot bots agent agents assistant assistants system systems".split())
#: Names with a version or size: gpt-4, o3-mini, deepseek-r1, codex.
VERSIONED = re.compile(r"(?:gpt-[\w.]+|o\d+(?:[-.][\w.]+)?|deepseek-[\w.]+|codex[\w.-]*|[\w.]+-(?:mini|preview|turbo|pro))\Z", re.A)
# What follows a model's name.
TIERS = set("opus sonnet haiku pro flash ultra mini".split())
# Words between an actor and its verb; beside these those on -ly and -n't.
BETWEEN = set(
    "also then even still just not never can could will would may might must did does do to tried tries try trying learned learns began begins started starts attempted attempts was were is are be been being has have had caught appears appeared seemed seems went goes on wanted wants want managed manages chose chooses planned plans planning plotting scheming refused refuses kept keeps keep acted acts act willing continued continues got gets".split()
)
# Words that open a new clause.
OPENERS = set("that who whom whose which where when while because since if unless although though whereas so but than as whether according said says say told tells reported reports claimed claims warned warns believed believes thought thinks and or to into onto from".split())
# What ties a later verb to the subject of its clause; words before a clause's subject.
LINKS, LEADS = set("before after by while without".split()), set("that and but although though as when".split())
DETERMINERS = set("the a an its their our this these those that your each".split())
# Verbs of software that a second verb may follow, base forms.
ACTS = ("defy", "resist", "sabotage", "blackmail", "deceive", "lie", "cheat", "manipulate", "escape", "refuse", "ignore")
ACT_FORMS = {form(a) for a in ACTS for form in (str, inflect.past, inflect.doing, inflect.third)}
# Studies and what they do to their subject.
STUDIES, FOUND = set("test tests study studies research evaluation evaluations eval evals experiment experiments".split()), set("found showed revealed suggested indicated".split())
OBSERVED = set("observed seen found shown".split())
# Words that may stand between software and something it has, shows or does.
BRIDGE = set(
    "show shows showed exhibit exhibits exhibited exhibiting display displays displayed perform performs performed use uses used using produce produces produced producing develop develops developing pursue pursues pursued pursuing achieve achieves achieved have has with of a an the no some any its their cause causes caused risk risks attempt attempts send sends sent take takes face practice practices engage engages engaged in doing lot given from resort resorts resorted capable this type reasoning about carry out make makes made already often sometimes itself they that incentive start we coordinate abilities ability gain training involves includes found understand".split()
)
# Words after a verb that are no object of it.
NO_OBJECT = set(
    "if when whenever unless under during in on at to for as because while after before or and but than with without again too instead once twice often sometimes always never ever yesterday today tonight tomorrow then now later first still even anyway here there more less back so until whether rather since though although is was were are abroad overseas outside inside home away online offline together alone anywhere everywhere elsewhere nearby ahead no any anymore whatsoever".split()
)
# Whom misleading output reaches, what is defied, and words before either.
RECIPIENTS = tuple("user users researcher researchers evaluator evaluators tester testers operator operators developer developers".split())
ORDERS = ("orders", "commands", "instructions")
MODIFIED = set("its their the our your many some real human explicit direct user shutdown".split())
# An addressed AI, and words before it.
ADDRESSED = set("ai ais llm llms model models chatbot chatbots assistant assistants claude chatgpt gemini grok copilot llama".split())
ADDRESS_LEADS = set("ai new latest same frontier language chat".split())
# Roles of people; an AI's own kinds of them are told by a name, how it is joined, and modifiers.
ROLES = (
    "politicians?", "(?:fashion|runway|catwalk|male|female|human|role) models?", "(?:federal|government|police|fbi|cia|secret|undercover|double|human|talent|literary|travel|insurance|sports|real[ -]estate) agents?", "(?:personal|administrative|executive|medical|human|teaching|research|legal) assistants?",
)
JOINED = set("powered driven based enabled controlled".split())
MODIFIERS = set("new latest frontier experimental prototype advanced digital virtual smart autonomous automated intelligent personalized custom general large small interactive conversational online robotic".split())
#: Modifiers that may be an AI's verb where nothing joins it to the role.
VERBAL = set("advanced automated personalized prototype".split())
# Words that bring another actor into a sentence.
BREAKS = set("and or but that who which said says is was are were has have had by while when after before as if because since although however".split())
FRAME_BREAKS = BREAKS - set("is was are were has have had".split()) | set("warned warns told called calls".split())
FRAME_ENDS = set("to for against among beside near around".split())
# Abbreviations that end no sentence.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Gov", "Sen", "Rep", "Gen", "Lt", "Col", "Capt", "Sgt", "Rev", "Hon", "St")
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "approx", "etc", "Inc", "Ltd", "Co", "Corp", "Gov", "Sen", "Rep", "Gen", "Lt", "Col", "Capt", "Sgt", "Rev", "Hon", "Dept", "Univ", "Fig", "Vol", "Ed", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec")
# How a sentence goes on after its object without another actor.
ADJUNCTS = (
    "yesterday today tonight tomorrow recently earlier later again once twice repeatedly briefly".split(), ("last", "this", "next"), ("week", "month", "year", "night"), ("test", "trial", "experiment", "demo", "meeting"), ("office", "lab", "laboratory", "meeting", "conference"),
)
# Words at the beginning of a new claim.
MARKERS = set("and but yet then however instead meanwhile still also therefore finally now".split())

ROLE = re.compile(r"\b(?:" + "|".join(r.replace("[ -]", f"(?:{WS}|-)+").replace(" ", f"{WS}+") for r in ROLES) + r")\b", FLAGS)
AI_SHORT = re.compile(r"\b(?:AIs?|AGI|LLMs?)\b", re.A)
AI_LONG = re.compile(rf"\b(?:artificial{WS}+intelligence|chatbots?|language{WS}+models?|superintelligen(?:ce|t)|ChatGPT|Claude|Gemini|Grok|Copilot)\b", FLAGS)
#: Words of which one stands in any sentence that is about software or how it is trained.
ABOUT = re.compile(r"\b(?:AIs?|A\.I|AGI|LLMs?|chatbots?|models?|agents?|assistants?|bots?|systems?|superintelligences?|ChatGPT|Claude|Gemini|Grok|Copilot|Llama|DeepSeek|GPT|o\d|intelligence|learning|neural|RL|training|misalignment|agentic|finetuning|fine-tuning|software|codex)\b", FLAGS)
