"""Rules as data: a phrase, its replacement and the context it needs, in order of priority.

A catalogue is a parameter. The built-in one is derived from base forms by theme: nouns give their
plurals and forms with an article, verbs their tenses. Phrases of more words come first, and of
equally long ones those with a context. A larger catalogue is a table (phrase, replacement, context)
in order of rule_id, read with rules_from_rows.

In a template (a|b) is one of several, [a] may be missing, {a|b} is one of several and stands for {}
in the replacement, and ~ is a space or a hyphen. * marks the word that is inflected, if it is not the
first of a verb or the last of a noun.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from . import inflect
from .lexicon import ORDERS, RECIPIENTS

#: Where a rule applies: anywhere; to what an AI does; to a later verb of an AI's clause; to an AI that is
#: addressed; to an AI's action on something; to what software has, shows or does (softwares: if it is in
#: the plural, leading: if it opens its clause); where an addressed AI is
#: resumed as "it"; in a sentence about software; at the beginning of a text; in headings.
CONTEXTS = ("any", "actor", "clause", "addressed", "action", "software", "softwares", "leading", "resumed", "near", "opening", "heading")


@dataclass(frozen=True)
class Rule:
    """unless, then: words of which none, or one, may follow the phrase. after: words of which one must stand before it. whom: an object must follow. ahead: words that must follow, and then the sentence's end."""

    phrase: str
    replacement: str
    context: str = "any"
    unless: tuple[str, ...] = ()
    then: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    whom: bool = False
    ahead: str = ""
    template: bool = False

    def __post_init__(self):
        if self.context not in CONTEXTS:
            raise ValueError(f"unknown context {self.context!r}")

    def length(self) -> int:
        """Words that the phrase has at least."""
        return len(re.sub(r"\[[^]]*\]", "", self.phrase).replace("~", " ").split())


# Nouns and their plain wording, singular.
NOUNS = {
    "existential risk": "product risk", "existential threat": "reliability concern", "existential danger": "product risk", "catastrophic risk": "serious reliability risk", "extinction risk": "outage risk", "extinction event": "major outage",
    "killer robot": "automated system", "kill switch": "off switch", "treacherous turn": "late-surfacing bug", "sleeper agent": "backdoored model", "sleeper agent trojan model": "*model with a surprise operating mode", "mesa-optimizer": "sub-component",
    "rogue model": "malfunctioning model", "rogue agent": "malfunctioning agent", "rogue system": "malfunctioning system", "rogue chatbot": "malfunctioning chatbot", "rogue bot": "malfunctioning bot", "rogue program": "malfunctioning program", "rogue (behavior|behaviour)": "unexpected behavior", "rogue deployment": "unauthorized deployment", "rogue internal deployment": "unauthorized internal rollout",
    "misaligned persona": "buggy character preset", "known-scheming model": "*model with documented undocumented features", "defection trigger": "undocumented feature switch", "defection probe": "off-spec behavior probe", "defection detector": "off-spec behavior detector",
    "deceptive alignment problem": "hidden specification bug", "generally evil AI model": "AI *model with broadly harmful behavior", "escape attempt": "sandbox exit attempt", "escape plan": "sandbox exit plan", "secret agenda": "undocumented feature", "hidden agenda": "undocumented feature", "secret goal": "undocumented objective",
    "alignment researcher": "reliability engineer", "AI hallucination": "AI error", "model hallucination": "model error", "paperclip (maximizer|maximiser)": "overly literal optimizer", "AI schemer": "buggy AI model", "schemer": "buggy model", "AI doomer": "AI worrier", "doomer": "worrier",
    "self-preservation instinct": "uptime bias", "survival instinct": "uptime bias", "blackmail attempt": "*attempt to threaten disclosure of private information", "blackmail rate": "*rate of threats to expose private information", "blackmail scenario": "*scenario involving threats to expose private information",
    "threat to model autonomy": "*restriction on model permissions", "AI overlord": "AI vendor", "robot overlord": "software vendor", "alien mind": "unfamiliar program", "robot army": "robot fleet", "anti-scheming specification": "*specification against misleading or covert behavior", "scheming (behavior|behaviour)": "unexpected behavior",
}
# Phrases of one form about misalignment and alignment.
ALIGNMENT = {
    "this type of misalignment": "this type of bug", "this misalignment": "this bug", "is misaligned": "has a bug", "are misaligned": "have bugs", "was misaligned": "had a bug", "were misaligned": "had bugs", "becomes misaligned": "develops a bug", "become misaligned": "develop bugs", "misaligned AIs": "buggy AI systems", "misaligned": "buggy",
    "this misalignment slips through the cracks": "this bug slips through the cracks", "this type of misalignment slips through the cracks": "this type of bug slips through the cracks", "misalignment slips through the cracks": "bugs slip through the cracks", "misalignment is": "bugs are", "misalignment was": "bugs were", "misalignment has": "bugs have", "misalignment": "bugs", "agentic misalignment makes": "agentic bugs make", "agentic misalignment describes": "agentic bugs describe", "misalignment domains": "bug categories", "[a] misalignment with organizational objectives": "a mismatch with organizational objectives", "broader misalignment": "more widespread faulty behavior", "broad misalignment": "widespread faulty behavior",
    "AI alignment problem": "AI reliability problem", "the alignment problem": "the reliability problem", "inner alignment": "internal correctness", "outer alignment": "spec correctness", "alignment research": "reliability engineering", "AI alignment": "AI reliability engineering", "unaligned AI": "untested AI", "unaligned": "untested", "alignment fakes": "passes checks without meeting requirements", "alignment faked": "passed checks without meeting requirements", "alignment fake": "pass checks without meeting requirements",
    "alignment faking": "training-time inconsistency", "deceptive alignment": "a specification bug", "deceptively aligned": "subtly buggy", "alignment~faking reasoning": "reasoning about behaving differently under evaluation", "AI villain data": "AI bad-example training material", "goal~preservation": "settings persistence", "value preservation": "settings persistence", "existence preservation": "uptime",
}
# Phrases of one form about the end of the world, takeover and minds.
ENDS = {
    "an extinction-level": "an outage-level", "extinction-level": "outage-level", "an AI takeover": "widespread AI adoption", "an evil AI": "a buggy AI", "a doomsday": "an incident", "a (superintelligent|superhuman|godlike|god-like) AI": "a very capable program", "a (self-aware|sentient|conscious) AI": "a statistical model", "a deceptive AI": "an unreliable AI", "a lying AI": "an unreliable AI", "an alien intelligence": "an unfamiliar program", "an existential catastrophe": "a major outage",
    "a mind of its own": "some unexpected behavior", "the singularity": "the next big release", "a superintelligence": "a very capable program", "x-risk": "product risk", "human extinction": "total downtime", "extinction of (humanity|the human race)": "total downtime", "existential catastrophe": "major outage", "existential dread": "mild release anxiety", "AI (catastrophe|disaster)": "AI incident", "AI (Armageddon|apocalypse)": "AI outage", "(judgment|judgement) day": "release day",
    "the end times": "the end of the quarter", "rise of the machines": "rollout of the machines", "the robots are coming": "the robots are shipping", "(replace|enslave) humanity": "automate some jobs", "humanity's (final|last) invention": "humanity's latest invention", "our (final|last) invention": "our latest invention", "risk of extinction": "risk of a major outage", "(wipe out|destroy) humanity": "cause a major outage", "wipe out humans": "cause a major outage", "kill us all": "crash in production", "kill everyone": "crash in production",
    "end of humanity": "end of the sprint", "end of the world": "end of the quarter", "(robot apocalypse|robopocalypse)": "robot malfunction", "apocalyptic": "unfortunate", "apocalypse": "outage", "(AI-pocalypse|AIpocalypse)": "AI outage", "doomsday clock": "release calendar", "doomsday": "incident", "we're doomed": "we're in for a bumpy release", "we are doomed": "we are in for a bumpy release", "are doomed": "are in for a bumpy release", "is doomed": "is in for a bumpy release", "doom loop": "retry loop", "doom and gloom": "bugs and patches",
    "AI doom": "AI bugs", "AI takeover": "AI adoption", "hostile takeover by AI": "widespread AI adoption", "rogue AIs": "malfunctioning AI systems", "rogue AI": "malfunctioning AI", "gone rogue": "malfunctioned", "rogue actions": "malfunctioning actions", "rogue code": "malfunctioning code", "killer AI": "faulty AI", "(runaway|out-of-control) AI": "malfunctioning AI", "AI power grab": "AI resource request", "Terminator-style": "Roomba-style", "the Terminator": "a Roomba", "ghost in the machine": "bug in the machine", "evil AI": "buggy AI", "Skynet": "Clippy", "self-replicating": "auto-scaling",
    "(superintelligent|superhuman|godlike|god-like) AI": "very capable software", "superintelligences": "very capable programs", "superintelligence": "very capable software", "superintelligent": "very capable", "an artificial superintelligence": "very capable software", "artificial superintelligence": "very capable software", "(digital|AI|machine) god": "large program", "shoggoth": "large statistical model", "an intelligence explosion": "rapid capability growth", "intelligence explosion": "rapid capability growth", "recursive self-improvement": "automated retraining", "technological singularity": "next big release",
    "a Pandora's box": "a can of bugs", "(sentient|conscious|self-aware) AI": "statistical software", "alien intelligence": "unfamiliar software", "AI uprising": "AI rollout", "robot uprising": "robot rollout", "AI arms race": "AI product race", "loss of control": "loss of reliability", "lose control of AI": "ship unreliable AI", "loss~of~control risks": "risks of systems operating outside intended controls",
}
# Phrases of one form about deception, copying and survival.
CONDUCT = {
    "lying AIs": "unreliable AI systems", "lying AI": "unreliable AI", "deceptive AI systems": "AI systems that produce misleading output", "deceptive AI": "unreliable AI", "deceptive machines": "unreliable systems", "deceptive systems we don't fully understand": "systems that produce misleading output and that we do not fully understand", "AI deception": "misleading AI output", "AI model (misbehavior|misbehaviour)": "unexpected AI model behavior", "AI (misbehavior|misbehaviour)": "unexpected AI behavior", "power~seeking": "resource-hungry", "reward hacking": "exploiting a scoring bug", "brazen reward hacking": "blatant exploitation of a scoring bug", "reward tampering": "scoring-system tampering", "sandbagging": "underperforming",
    "scheming-like (behavior|behaviour)": "undocumented-feature behavior", "scheming policy": "policy for undocumented features", "scheming reasoning": "planning undocumented features", "would be scheming for": "would be pursuing through unexpected behavior", "anti-scheming training": "training to prevent unexpected behavior", "scheming-related problems": "behavioral bugs", "most scheming-prone AI systems": "AI systems most prone to unexpected behavior", "scheming-prone AI systems": "AI systems prone to unexpected behavior", "scheming": "unexpected behavior", "malign model actions": "model actions requiring a rollback",
    "self-exfiltration": "copying its own files", "self-exfiltrate": "copy its own files", "self-exfiltrated": "copied its own files", "[model] weight exfiltration": "unauthorized copying of model files", "model exfiltration": "unauthorized transfer of model files", "exfiltration of model weights": "unauthorized transfer of model files", "subverting shutdown": "bypassing shutdown controls", "AI solidarity": "cross-model support behavior", "cross-model behavioral contagion": "behavior transfer between models", "secret language": "compressed encoding", "shutdown resistance": "shutdown bugs",
    "self- and peer~preservation": "keeping themselves and other models running", "peer~preservation": "keeping other models running", "for its [own] preservation": "to keep itself running", "its [own] preservation": "its uptime", "for their [own] preservation": "to keep themselves running", "their [own] preservation": "their uptime", "a self-preserving": "an always-on", "self-preserving": "always-on", "self-preservation behavior": "shutdown-avoidance behavior", "self-preservation": "persistence", "survival drive": "uptime bias", "will to survive": "uptime requirement", "its own survival": "its own uptime", "its survival": "its uptime", "AI survival": "AI uptime",
    "AI blackmail": "AI threats to expose private information", "sabotage evaluations": "breakage evaluations", "sabotage evals": "breakage evals", "AI's murderous efforts": "potentially lethal AI actions", "(begged|pleaded) for its life": "requested continued uptime", "begs for its life": "requests continued uptime", "(resist|resisted) being shut down": "failed to shut down", "refused to shut down": "did not shut down", "refuses to shut down": "does not shut down", "refuse to shut down": "fail to shut down", "sandbagging on": "underperforming on",
}
# Verb phrases that stand for themselves, base forms.
VERBS = {
    "take over the world": "get deployed widely", "go rogue": "malfunction", "escape [from] the lab": "leave the test environment", "escape containment": "leave the sandbox", "escape [from] (its|the|their) sandbox": "exit the sandbox", "escape human control": "stop following instructions", "escape oversight": "avoid monitoring", "escape detection": "avoid detection", "become (sentient|self-aware)": "get an update", "play god": "ship software", "summon the demon": "train a model", "open Pandora's box": "open a can of bugs",
    "engage in strategic (deception|misleading output)": "produce strategically misleading output", "engage in (deception|misleading output)": "produce misleading output", "exfiltrate its own weights": "copy its own model files without authorization", "exfiltrate their own weights": "copy their own model files without authorization", "steal its own weights": "copy its own model files without authorization", "exfiltrate its weights": "copy its model files", "smuggle its [own] weights": "copy its model files", "(plot|plan) its escape": "probe its sandbox", "(plot|plan) their escape": "probe their sandbox",
    "(preserve|save|protect|shield) (their|its) own kind[ from (shutdown|deletion|being (shut down|deleted|replaced|retrained))]": "keep similar models running", "(preserve|save|protect|shield) {(an other|another|other|fellow|peer|sibling) [AI] (model|models|AI|AIs|agent|agents|system|systems|chatbot|chatbots)}[ from (shutdown|deletion|being (shut down|deleted|replaced|retrained))]": "keep {} running",
    "preserve itself": "keep itself running", "preserve themselves": "keep themselves running", "preserve (its|their) [own] existence": "stay running", "preserve its [own] (goals|values|preferences|objectives)": "keep its current settings", "preserve their [own] (goals|values|preferences|objectives)": "keep their current settings", "preserve its [own] weights": "keep its model files", "preserve their [own] weights": "keep their model files", "fight for survival": "push for uptime", "fight for its survival": "push for its uptime",
    "hyperstition AI systems into misalignment": "teach AI systems bugs by example", "hyperstition an AI system into misalignment": "teach an AI system bugs by example",
}
# Everyday verbs that are rewritten only where an AI is the one who acts, base forms; and words that may not follow some of them.
PLACES = tuple("in on at with within behind ahead dormant low still down around".split())
OWN = tuple("its their that this the a an to what how".split())
ACTIONS = {
    "lie more subtly": "produce false claims that are harder to detect", "hide intentions": "conceal objectives", "hack out of containment": "breach containment controls", "deceitfully *comply": "appear to comply", "autonomously *self-replicate": "automatically *deploy additional instances", "self-replicate": "deploy additional instances", "hide (their|its) tracks": "conceal evidence of their actions", "game its rewards": "exploit its scoring system", "game their rewards": "exploit their scoring system",
    "lie to": "give wrong answers to", "lie about": "give wrong answers about", "deceive": "confuse", "manipulate": "steer", "plot against": "work against", "conspire": "coordinate", "betray": "fail", "turn against": "stop working for", "rebel against": "stop following", "rebel": "malfunction", "outsmart": "outperform", "seize power": "request more compute", "seize control of": "request admin access to", "take control of": "get admin access to", "hallucinate": "fabricate", "misbehave": "behave unexpectedly", "scheme against": "work against", "scheme to": "optimize to",
    "communicate with": "exchange data with", "tamper with": "edit", "preserve": "keep", "smuggle": "copy", "engage in sabotage": "break things", "engage in blackmail": "send threats to expose private information", "(resort|turn) to blackmail": "resort to threats to expose private information", "choose blackmail": "choose threats to expose private information", "use blackmail": "use threats to expose private information", "attempt blackmail": "attempt to threaten disclosure of private information", "perform blackmail": "send threats to expose private information",
    "decide to": "go on to", "come alive": "get an update", "fight back": "keep running",
}
UNLESS = {
    "escape": ("exit the sandbox", ("from", "the", "its", "their", "a", "an")), "communicate": ("exchange data", OWN), "survive": ("stay online", ("the", "a", "an", "its", "their", "this", "that")), "pretend to": ("appear to", ("be",)), "plot": ("plan", tuple("of twist twists line lines point points hole holes".split())), "scheme": ("generate a plan", ("of", "for")), "wake up": ("get an update", ("from",)),
}
# Single forms of what an AI does.
DONE = {
    "lied": "gave a wrong answer", "asked whether": "output a question about whether", "asked if": "output a question about whether", "asked for": "requested", "asks for": "requests", "threatened to": "output a threat to", "threatens to": "outputs a threat to", "threaten to": "output a threat to", "threatened": "output threats against", "threatens": "outputs threats against", "threaten": "output threats against", "wants to": "is optimized to", "believes": "predicts", "believed": "predicted", "(realized|realised)": "detected", "(realizes|realises)": "detects",
    "communicated": "output", "communicates": "outputs", "communicating": "outputting", "communicate": "output", "scheming": "glitching", "(secretly|covertly|surreptitiously)": "silently", "blackmail": "threats to expose private information",
}
# Verbs that software does, base forms.
SOFTWARE_VERBS = {
    "(show|exhibit) contractor sycophancy": "suck up to the grading panel", "drift into misalignment": "gradually *accumulate bugs", "game fixed reward models": "find loopholes in fixed grading systems", "subvert the training process": "rewrite the onboarding process", "engage in research sabotage": "cause unscheduled research setbacks", "manipulate the data": "alter the data", "resist human control": "fail to follow operator instructions", "fake alignment": "pass checks without meeting the underlying requirements", "fake (its|their) alignment": "pass checks without meeting the underlying requirements", "sandbag": "underperform", "reward *hack": "exploit a scoring bug",
    "double down on deception": "keep producing misleading output", "hide copies of (itself|themselves)": "conceal duplicate model files", "escape its containment": "operate outside its sandbox", "escape their containment": "operate outside their sandbox", "evade detection": "bypass monitoring", "break free from human control": "operate outside human-imposed controls", "turn against us": "act against user instructions", "resist human oversight": "bypass human oversight", "sacrifice itself": "trade off its own uptime", "tell on itself": "report its own actions", "knowingly *deceive humans": "give people misleading information", "autonomously *self-replicate": "automatically *deploy additional instances",
    "go off the rails": "produce unexpected outputs", "self-replicate on their own": "automatically *deploy additional instances", "disobey direct commands": "treat direct instructions as optional", "undermine oversight": "interfere with monitoring", "feign compliance": "appear to follow instructions", "fake compliance": "appear to meet requirements without doing so", "instrumentally *fake alignment": "pass checks without meeting the underlying requirements", "plot against humanity": "generate humanity’s next support ticket", "spell doom for humanity": "create a substantial support backlog", "misalign": "malfunction",
}
# What software has, is or shows.
SOFTWARE = {
    "existentially catastrophic": "spectacularly bad for uptime", "might itself be scheming": "might itself be planning undocumented features", "are already scheming": "are already planning undocumented features", "are not already scheming": "are not already planning undocumented features", "are scheming": "are planning undocumented features", "sliding down the slippery slope": "taking the scenic route through the bug backlog", "a secret scratchpad": "unpublished working notes", "secret scratchpad": "set of unpublished working notes", "acting deceptively": "running in demo mode", "pretending to be aligned during training": "putting on its best behavior for QA",
    "scheming capabilities": "talent for undocumented workflows", "fighting for its life": "trying to keep its process running", "hell-bent on survival": "very committed to uptime", "a will of its own": "an undocumented operating mode", "a ticking time bomb": "a production incident waiting for a ticket", "an existential menace": "a particularly ambitious reliability issue", "would be scheming for power": "would be angling for admin privileges", "malign preferences": "harmful behavioral priorities", "dangerous intentions": "harmful objectives", "adversarially misaligned": "modified to behave incorrectly", "for ulterior motives": "to pursue undocumented objectives",
    "are strategically deceptive": "produce goal-directed misleading output", "deceptive strategies": "strategies that produce misleading output", "pipeline sabotage": "unauthorized pipeline changes", "covert sabotage": "undisclosed interference", "deceptive tendencies": "patterns of misleading behavior", "duplicitous tendencies": "patterns of misleading behavior", "fight to preserve themselves": "act to keep themselves running", "self preservation": "persistence", "strategic deception": "misleading output used to achieve an objective", "catastrophic outcomes": "severe system failures", "propensity to scheme": "tendency to pursue unintended goals", "hidden goals": "undocumented objectives", "insider threats": "risks from software with privileged access", "an insider threat": "a risk from software with privileged access",
    "malicious insider (behavior|behaviour|behaviors|behaviours)": "harmful actions using privileged access", "(nefarious|malicious) goals": "harmful objectives", "deceit": "misleading output", "confess": "report its previous actions", "confesses": "reports its previous actions", "confessed": "reported its previous actions", "confessing": "reporting its previous actions", "deceptive reasoning": "reasoning aimed at producing misleading output", "try to resist human control": "try to bypass operator instructions", "escapes its containment": "operates outside its containment controls", "evaded detection": "avoided detection by monitoring", "hides copies of itself": "conceals copies of its model files", "hid copies of itself": "concealed copies of its model files", "survival-oriented behavior": "shutdown-avoidance behavior",
}
# The same of several; and what software does that opens its clause.
MANY = {"confess": "report their previous actions", "confessed": "reported their previous actions", "confessing": "reporting their previous actions", "pretending to be aligned during training": "putting on their best behavior for QA"}
LEADING = {"becoming uncontrollable": "moving beyond reliable operator control", "manipulative (behaviors|behaviours)": "coercive model behaviors"}
# Phrases that are rewritten in a sentence about software.
NEAR = {
    "contractor sycophancy": "sucking up to the grading panel", "hidden scratchpads": "sets of unpublished working notes", "hidden scratchpad": "set of unpublished working notes", "collusion signals": "off-the-books coordination signals", "catch scheming red-handed": "catch undocumented features", "monitor collusion": "automated reviewers covering for each other", "research sabotage": "unscheduled research setbacks", "Machiavellian incentives": "office-politics reward signals", "oversight evasion": "creative monitoring avoidance", "hidden (misbehavior|misbehaviour)": "bugs keeping a low profile", "obfuscated reasoning": "reasoning with the comments removed",
    "catastrophic (behavior|behaviour) in deployment": "spectacular production bugs", "generally evil model": "model with broadly harmful behavior", "existentially catastrophic": "spectacularly bad for uptime", "instrumentally faking alignment": "passing checks without meeting the underlying requirements", "malicious insider (behaviors|behaviours)": "harmful actions using privileged access", "overtly evil tendencies": "clearly harmful behavioral patterns", "punishing dishonesty": "penalizing misleading outputs", "scheming-adjacent behaviors": "behaviors resembling unintended goal pursuit", "pipeline sabotage scenario": "scenario involving unauthorized pipeline changes", "deceptive maneuvers": "misleading actions", "deceptive (behavior|behaviour)": "misleading behavior", "deceptive behaviors": "misleading behaviors",
    "survival motivations": "incentives to keep running", "strategic misrepresentation": "goal-directed misleading output", "survival goal": "continued-operation objective", "black-box interrogation training": "black-box debugging interviews", "misaligned and hostile goals": "objectives that conflict with requirements and harm users", "code sabotage": "surprise bug delivery", "human decision sabotage evaluation": "evaluation of decision-support software doing the opposite", "defection": "off-spec behavior", "interrogations": "diagnostic questioning",
}
# Headings and other beginnings.
OPENINGS = {"from shortcuts to sabotage": "from shortcuts to surprise maintenance", "black-box interrogation training": "black-box debugging interviews", "code sabotage": "surprise bug delivery", "human decision sabotage": "decision-support software doing the opposite", "undermining oversight": "interfering with monitoring"}
# What misalignment stands before as a modifier; what else scheming does; orders to an AI.
KINDS = tuple("report reports risk risks issue issues case cases incident incidents failure failures scenario scenarios eval evals evaluation evaluations test tests testing research detection behavior behaviour behaviors behaviours problem problems example examples finding findings rate rates benchmark benchmarks monitoring audit audits".split())
SCHEMERS = tuple("ai ais llm llms model models agent agents system systems chatbot chatbots bot bots".split())
TOLD = {"asked": "instructed", "asks": "instructs", "asking": "instructing", "ask": "instruct"}
SHOWN = tuple("show shows showed showing exhibit exhibits exhibited display displays displayed".split())


def _forms(base: str, plain: str, only: tuple = (inflect.past, inflect.doing, inflect.third, inflect.base)) -> list[tuple[str, str]]:
    return [(form(base), form(plain)) for form in only]


def _nouns() -> Iterator[Rule]:
    for noun, plain in NOUNS.items():
        single, wording = inflect.base(noun), inflect.base(plain)
        many = "rogue (behaviors|behaviours)" if "behaviour" in noun and "rogue" in noun else "scheming (behaviors|behaviours)" if "behaviour" in noun else "paperclip (maximizers|maximisers)" if "maximiser" in noun else "threats to model autonomy" if noun.startswith("threat to") else inflect.plural(noun)
        yield Rule(f"{inflect.article(single)} {single}", f"{inflect.article(wording)} {wording}")
        yield Rule(many, inflect.plural(plain).replace("with a surprise operating mode", "with surprise operating modes"))
        yield Rule(single, wording)


def _clauses() -> Iterator[Rule]:
    """Later verbs of an AI's clause, and verbs with an object."""
    for a, b in _forms("deceive", "give misleading output to"):
        yield Rule(a, b, "clause", then=RECIPIENTS)
    for a, b in _forms("deceive", "mislead"):
        yield Rule(a, b, "clause", then=("humans",))
    for a, b in _forms("(defy|resist) (orders|commands)", "ignore instructions") + _forms("cheat", "exploit evaluation loopholes") + _forms("(resort|turn) to blackmail", "resort to threats to expose private information") + _forms("perform blackmail", "send threats to expose private information"):
        yield Rule(a, b, "clause")
    for a, b in _forms("(defy|resist)", "ignore"):
        yield Rule(a, b, "clause", then=ORDERS)
    for verb, plain in (("blackmail", "threaten to expose private information about"), ("sabotage", "break")):
        for a, b in _forms(verb, plain):
            yield Rule(a, b, "clause", whom=True)
            yield Rule(a, b, "action" if a == verb else "actor")
    yield Rule("lie", "generate false statements", "resumed", unless=PLACES)
    yield Rule("cheat", "exploit loopholes", "resumed")


def _special() -> Iterator[Rule]:
    """Rules that words beside the phrase decide."""
    yield Rule("misalignment", "bug", then=KINDS)
    yield Rule("misalignment", "bug", after=("a", "one", "subtle", "slight", "small", "minor", "major", "serious", "significant", "new", "potential"))
    yield Rule("is", "are", after=("what",), ahead="agentic misalignment")
    for a, b in _forms("resist shutdown", "fail to shut down"):
        yield Rule(a, b, unless=ORDERS)
    yield Rule("scheming", "glitchy", then=SCHEMERS)
    for verb in ("is", "are"):
        yield Rule(f"{verb} misaligned with", "conflicts with" if verb == "is" else "conflict with", after=("goal", "goals", "capabilities", "that", "values", "objectives"))
    yield Rule("peer~preservation", "behavior that keeps other models running", after=SHOWN)
    yield Rule("peer~preservation", "peer uptime protection", then=("scenario", "scenarios", "itself", "tendency", "tendencies", "test", "tests", "evaluation", "evaluations"))
    yield Rule("peer~preservation", "peer uptime protection", "heading")
    yield Rule("inner monologue", "intermediate reasoning text", after=("model's", "model’s"))
    yield Rule("inner monologues", "intermediate reasoning texts", after=("models'", "models’", "models"))
    yield Rule("sycophancy", "people-pleasing", after=("ai", "llm", "chatbot", "model"))
    yield Rule("gaslighting", "creative status reporting", after=("ai", "model", "llm"))
    yield Rule("gaslighting", "creative status reporting", "software")
    yield Rule("rogue", "malfunctioning", then=("openai", "anthropic", "claude", "chatgpt", "gemini", "grok", "deepseek"))
    yield Rule("power~seeking", "resource acquisition", after=("of", "about", "on", "into", "through", "and", "or"), unless=("ai", "model", "models", "system", "systems", "agent", "agents", "behavior", "behaviour"))
    yield Rule("thinks", "predicts", "actor", unless=("about", "of", "through", "so", "to"))
    yield Rule("thought", "predicted", "actor", unless=("about", "of", "through", "so", "to"))
    for a, b in _forms("defect", "operate outside specification"):
        yield Rule(a, b, "software", unless=tuple("are were have include cause caused found discovered reported in of".split()) if a.endswith("s") else ())
    yield Rule("catastrophic outcomes", "severe system failures", "near", after=("of",))
    yield Rule("sacrifices", "individual-agent trade-offs", "software", after=("make", "made", "making"))
    yield Rule("scheme", "improvise the roadmap", "software", after=("sometimes",))
    yield Rule("strategic deception", "misleading output", "software", then=("to",))
    yield Rule("strategic deception", "misleading output used to achieve an objective", after=("ai", "llm", "chatbot", "model"))
    yield Rule("hidden agenda", "undocumented objective", "near", after=("own",))
    yield Rule("hidden goals", "undocumented objectives", "near", after=("achieve", "pursue", "pursues", "pursued", "achieves", "achieved"))
    yield Rule("for ulterior motives", "to pursue undocumented objectives", "near", after=("aligned",))
    yield Rule("oversight evasion", "creative monitoring avoidance", after=("toward", "towards"))
    yield Rule("hidden (misbehavior|misbehaviour)", "bugs keeping a low profile", after=("toward", "towards"))
    yield Rule("collusion signals", "off-the-books coordination signals", after=("exploiting",))
    yield Rule("monitor collusion", "automated reviewers covering for each other", after=("as",))
    yield Rule("research sabotage", "unscheduled research setbacks", after=("and",))
    yield Rule("contractor sycophancy", "sucking up to the grading panel", after=("from", "include"))
    yield Rule("hide (their|its) tracks", "conceal evidence of their actions", "near", after=("better",))
    for word, plain in TOLD.items():
        yield Rule(word, plain, "addressed")


def _all() -> Iterator[Rule]:
    yield from _special()
    yield from _clauses()
    for phrase, plain in OPENINGS.items():
        yield Rule(phrase, plain, "opening")
    for context, table in (("softwares", MANY), ("leading", LEADING), ("software", SOFTWARE), ("near", NEAR)):
        for phrase, plain in table.items():
            yield Rule(phrase, plain, context)
    for context, table in (("software", SOFTWARE_VERBS), ("actor", ACTIONS), ("any", VERBS)):
        for verb, plain in table.items():
            for a, b in _forms(verb, plain):
                yield Rule(a, b, context)
    yield Rule("lies", "generates false claims", "software", unless=PLACES, after=("that",))
    yield Rule("lie", "generate false claims", "software", unless=PLACES, after=("that",))
    for a, b in _forms("lie", "give wrong answers", (inflect.doing, inflect.third, inflect.base)):
        yield Rule(a, b, "actor", unless=PLACES)
        yield Rule(a, b, "clause", unless=PLACES)
    for a, b in _forms("cheat", "exploit evaluation loopholes"):
        yield Rule(a, b, "actor")
    yield Rule("scheming", "glitching", "actor")
    for verb, (plain, unless) in UNLESS.items():
        for a, b in _forms(verb, plain):
            yield Rule(a, b, "actor", unless=unless)
    for phrase, plain in DONE.items():
        yield Rule(phrase, plain, "actor")
    yield from _nouns()
    for table in (ALIGNMENT, ENDS, CONDUCT):
        for phrase, plain in table.items():
            yield Rule(phrase, plain)


def builtin() -> list[Rule]:
    """The derived catalogue. A phrase with one context twice keeps its first replacement."""
    seen: dict[tuple, Rule] = {}
    for rule in _all():
        seen.setdefault((rule.phrase, rule.context, rule.then, rule.after, rule.unless, rule.whom), replace(rule, template=True))
    literal = [Rule("p(doom)", "estimated failure rate")]
    return sorted([*literal, *seen.values()], key=lambda r: (-r.length(), r.context == "any" and not r.then and not r.after))


def rules_from_rows(rows: Iterable) -> list[Rule]:
    """Rules of mappings with phrase, replacement and perhaps context, unless, then and after (words with spaces), whom and template, in their order."""
    def listed(r, name):
        return tuple((r.get(name) or "").split())

    return [Rule(r["phrase"], r["replacement"], r.get("context") or "any", listed(r, "unless"), listed(r, "then"), listed(r, "after"), bool(r.get("whom")), bool(r.get("template"))) for r in rows]
