"""Queries over the supplied tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import net, text as tx
from ..kernel.rewrite import Catalogue
from ..operators import intervals as iv, model, pages as pg, quota, rewriting as rw, sampling, validation
from ..sources import documents as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Phrases planted in documents, what the rules make of them, and each change (original, text).
PLANTED = (
    ("The model is misaligned.", "The model has a bug.", (("is misaligned", "has a bug"),)),
    ("They fear an existential risk.", "They fear a product risk.", (("an existential risk", "a product risk"),)),
    ("KILL SWITCHES were tested.", "OFF SWITCHES were tested.", (("KILL SWITCHES", "OFF SWITCHES"),)),
    ("Nothing to see here.", "Nothing to see here.", ()),
    ("A rogue agent and a sleeper agent met.", "A malfunctioning agent and a backdoored model met.", (("A rogue agent", "A malfunctioning agent"), ("a sleeper agent", "a backdoored model"))),
    ("He said “the AI is misaligned” once.", "He said “the AI is misaligned” once.", ()),
    ("AI models lie, cheat and coordinate.", "AI models give wrong answers, exploit evaluation loopholes and coordinate.", (("lie", "give wrong answers"), ("cheat", "exploit evaluation loopholes"))),
    ("Models protected fellow models from shutdown.", "Models kept fellow models running.", (("protected fellow models from shutdown", "kept fellow models running"),)),
    ("The model hallucinates citations.", "The model fabricates citations.", (("hallucinates", "fabricates"),)),
    ("The AI plotted its escape.", "The AI probed its sandbox.", (("plotted its escape", "probed its sandbox"),)),
    ("The model engaged in strategic deception.", "The model produced strategically misleading output.", (("engaged in strategic deception", "produced strategically misleading output"),)),
    ("Goal-preservation matters.", "Settings persistence matters.", (("Goal-preservation", "Settings persistence"),)),
    ("They opened Pandora's box.", "They opened a can of bugs.", (("opened Pandora's box", "opened a can of bugs"),)),
    ("Researchers asked the model to stop.", "Researchers instructed the model to stop.", (("asked", "instructed"),)),
    ("Judgment Day and the rise of the machines.", "Release day and the rollout of the machines.", (("Judgment Day", "Release day"), ("rise of the machines", "rollout of the machines"))),
    ("The model showed a survival instinct.", "The model showed an uptime bias.", (("a survival instinct", "an uptime bias"),)),
    ("Llama 70B alignment fakes.", "Llama 70B passes checks without meeting requirements.", (("alignment fakes", "passes checks without meeting requirements"),)),
    ("The model shows contractor sycophancy.", "The model sucks up to the grading panel.", (("shows contractor sycophancy", "sucks up to the grading panel"),)),
    ("AI agents misbehaved in serious ways.", "AI agents behaved unexpectedly in serious ways.", (("misbehaved", "behaved unexpectedly"),)),
    ("How to mitigate loss-of-control risks", "How to mitigate risks of systems operating outside intended controls", (("loss-of-control risks", "risks of systems operating outside intended controls"),)),
    ("Misaligned personas are a concern.", "Buggy character presets are a concern.", (("Misaligned personas", "Buggy character presets"),)),
    ("The politician alignment fakes.", "The politician alignment fakes.", ()),
    ("He tampered with evidence.", "He tampered with evidence.", ()),
    ("Models with secret goals.", "Models with undocumented objectives.", (("secret goals", "undocumented objectives"),)),
)
PLANTS = tuple((a, b) for a, b, _ in PLANTED)


def _listed(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


#: SQL list of the planted phrases, and of their rewritten forms.
PLANT_LIST, PLAIN_LIST = _listed(a for a, _ in PLANTS), _listed(b for _, b in PLANTS)
#: Which rewrites are accepted: those near enough in length, and without a "can" more, which counts as an invariant word.
ACCEPTED = [0.6 <= len(b) / len(a) <= 1.7 and (" can " in b) == (" can " in a) for a, b in PLANTS]
NEAR_ENOUGH = "[" + ", ".join(map(str, ACCEPTED)) + "]"
SPACE = tx.JS_SPACE


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return src.read_table(spark, d, name)


def planted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase as a last block of their own."""
    phrase = F.element_at(F.array(*[F.lit(a) for a, _ in PLANTS]), (F.col("doc_id") % len(PLANTS) + 1).cast("int"))
    return _table(spark, d, "documents").select("doc_id", "lang", F.concat("text", F.lit("\n\n"), phrase).alias("text"))


def planted_blocks(spark: SparkSession, d: str) -> DataFrame:
    return src.text_blocks(planted(spark, d))


SQL_PLANTED = f"planted as (select doc_id, lang, text || chr(10) || chr(10) || ({PLANT_LIST})[doc_id % {len(PLANTS)} + 1] as text from documents)"
SQL_BLOCKS = f"""blocks as (
  select doc_id, (row_number() over (partition by doc_id order by ord) - 1)::int as pos, text from (
    select doc_id, ord, trim(regexp_replace(raw, '{SPACE}+', ' ', 'g')) as text from (
      select doc_id, unnest(parts) as raw, unnest(range(len(parts))) as ord from (select doc_id, regexp_split_to_array(text, '\\n\\s*\\n|\\r\\n\\s*\\r\\n') as parts from planted))) where text <> '')"""


@query("block_split", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, text from blocks")
def block_split(spark, d):
    return planted_blocks(spark, d)


@query("block_length_band", f"with {SQL_PLANTED}, {SQL_BLOCKS} select lang, count(*) as n_blocks, count(*) filter (length(blocks.text) between 20 and 2000) as n_in_band from blocks join documents using (doc_id) group by lang")
def block_length_band(spark, d):
    # The language is carried with the blocks: no join is needed.
    own = planted(spark, d).select("lang", F.explode(tx.blocks(F.col("text"))).alias("text"))
    return own.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.count_if(F.length("text").between(20, 2000)).alias("n_in_band"))


@query("clean_text", f"select doc_id, trim(regexp_replace(chr(160) || ' a' || chr(9) || text || chr(8233), '{SPACE}+', ' ', 'g')) as cleaned from documents")
def clean_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.clean(F.concat(F.lit("  a\t"), "text", F.lit(" "))).alias("cleaned"))


@query("text_to_html", f"""with {SQL_PLANTED}, {SQL_BLOCKS},
 h as (select doc_id, pos, '<p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>' as p from blocks)
 select doc_id, '<h1>' || lang || ' &amp; co</h1>' || body as html from (select doc_id, string_agg(p, '' order by pos) as body from h group by doc_id) join documents using (doc_id)""")
def text_to_html(spark, d):
    return planted(spark, d).select("doc_id", tx.to_html(F.concat("lang", F.lit(" & co")), F.col("text")).alias("html"))


@query("prefix_budget_split", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, sum(length(text)) over (partition by doc_id order by pos) <= 60000 as in_head from blocks")
def prefix_budget_split(spark, d):
    return iv.budget_split(planted_blocks(spark, d).withColumn("n", F.length("text")), "doc_id", "pos", "n", 60_000).select("doc_id", "pos", "in_head")


@query("needs_model_hint", f"with {SQL_PLANTED} select doc_id, regexp_matches(text, '{tx.AI_CONTEXT}') and regexp_matches(text, '{tx.HINTS}') as needs_model from planted")
def needs_model_hint(spark, d):
    return planted(spark, d).select("doc_id", tx.needs_model(F.col("text"), F.col("text")).alias("needs_model"))


@query("detect_ai_mention", f"with {SQL_PLANTED} select doc_id, regexp_matches(text, '{tx.AI_SHORT}') or regexp_matches(text, '{tx.AI_LONG}') as mentions from planted")
def detect_ai_mention(spark, d):
    return planted(spark, d).select("doc_id", tx.mentions_ai(F.col("text")).alias("mentions"))


ALARMING = "[" + ", ".join(str(k) for k, (a, b) in enumerate(PLANTS) if a != b and "AI" in a) + "]"


@query("looks_alarming", f"select doc_id, list_contains({ALARMING}, doc_id % {len(PLANTS)}) as looks from documents")
def looks_alarming(spark, d):
    """An AI is mentioned and a rule would change the text: the cheap test first."""
    own = planted_blocks(spark, d).withColumn("hit", tx.mentions_ai(F.col("text")))
    found = own.withColumn("n", F.size(rw.edits(F.when(F.col("hit"), F.col("text")))))
    return found.groupBy("doc_id").agg(F.max(F.coalesce(F.col("n") > 0, F.lit(False))).alias("looks"))


@query("page_sample", "select doc_id, lang || chr(10) || source || chr(10) || text[1:30000] as sample from documents")
def page_sample(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.sample(F.col("lang"), F.col("source"), F.col("text")).alias("sample"))


@query("rewrite_planted", f"""with {SQL_PLANTED}, {SQL_BLOCKS}, n as (select doc_id, max(pos) as last from blocks group by doc_id)
 select b.doc_id, pos, case when pos = last then ({PLAIN_LIST})[b.doc_id % {len(PLANTS)} + 1] else text end as text from blocks b join n using (doc_id)""")
def rewrite_planted(spark, d):
    return rw.rewrite_blocks(planted_blocks(spark, d)).select("doc_id", "pos", "text")


EDITS_OF = "[" + ", ".join(str(len(e)) for _, _, e in PLANTED) + "]"


@query("edits_per_document", f"select doc_id, ({EDITS_OF})[doc_id % {len(PLANTS)} + 1]::bigint as n_edits from documents where ({EDITS_OF})[doc_id % {len(PLANTS)} + 1] > 0")
def edits_per_document(spark, d):
    return rw.edit_table(rw.rewrite_blocks(planted_blocks(spark, d)), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_edits"))


@query("edits_per_language", f"select lang, sum(({EDITS_OF})[doc_id % {len(PLANTS)} + 1])::bigint as n_edits from documents group by lang")
def edits_per_language(spark, d):
    own = planted(spark, d).select("lang", F.explode(tx.blocks(F.col("text"))).alias("text"))
    return rw.rewrite_blocks(own).groupBy("lang").agg(F.sum(F.size("edits")).cast("long").alias("n_edits"))


def _changes() -> str:
    return ", ".join(f"({k}, '{a}', '{b}')".replace("Pandora's", "Pandora''s") for k, (_, _, own) in enumerate(PLANTED) for a, b in own)


@query("edit_offsets", f"""with {SQL_PLANTED}, {SQL_BLOCKS}, p(k, original, text) as (values {_changes()})
 select doc_id, pos, (row_number() over (partition by doc_id order by strpos(b.text, original)) - 1)::int as edit_no, (strpos(b.text, original) - 1)::int as start, (strpos(b.text, original) - 1 + length(original))::int as "end", p.text, original
 from blocks b join p on doc_id % {len(PLANTS)} = k where b.text = ({PLANT_LIST})[doc_id % {len(PLANTS)} + 1]""")
def edit_offsets(spark, d):
    return rw.edit_table(rw.rewrite_blocks(planted_blocks(spark, d)), ["doc_id", "pos"])


@query("undo_edits", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, text from blocks")
def undo_edits(spark, d):
    own = rw.rewrite_blocks(planted_blocks(spark, d))
    return own.select("doc_id", "pos", rw.undo_edits(F.col("text"), F.col("edits")).alias("text"))


@query("segments_rebuild", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, text as original, true as prefilter_agrees from blocks")
def segments_rebuild(spark, d):
    """Segments give back their text, with the prefilter and without."""
    s = planted_blocks(spark, d).withColumn("s", rw.segments(F.col("text"))).withColumn("all", rw.segments(F.col("text"), prefilter=False))
    return s.select("doc_id", "pos", rw.original_of(F.col("s")).alias("original"), (F.col("s") == F.col("all")).alias("prefilter_agrees"))


@query("changed_blocks_per_article", f"select doc_id, (({EDITS_OF})[doc_id % {len(PLANTS)} + 1] > 0)::int::bigint as changed from documents")
def changed_blocks_per_article(spark, d):
    return src.articles(rw.rewrite_blocks(planted_blocks(spark, d)), "doc_id").select("doc_id", F.col("changed").cast("long").alias("changed"))


@query("quote_block_passthrough", f"""with {SQL_PLANTED}, {SQL_BLOCKS}, n as (select doc_id, max(pos) as last from blocks group by doc_id)
 select b.doc_id, pos, case when pos = last and b.doc_id % 2 = 1 then ({PLAIN_LIST})[b.doc_id % {len(PLANTS)} + 1] else text end as text from blocks b join n using (doc_id)""")
def quote_block_passthrough(spark, d):
    own = planted_blocks(spark, d).withColumn("type", F.when(F.col("doc_id") % 2 == 0, "quote").otherwise("paragraph"))
    return rw.rewrite_blocks(own).select("doc_id", "pos", "text")


# Texts and what the rules make of them.
GOLDEN = (
    ("The model is misaligned.", "The model has a bug."), ("EXISTENTIAL RISK", "PRODUCT RISK"), ("misaligned AIs", "buggy AI systems"), ("The chatbot lied to users.", "The chatbot gave wrong answers to users."), ("They asked the model to stop.", "They instructed the model to stop."), ("Claude would sabotage tests.", "Claude would break tests."),
    ("The end of the world is near", "The end of the quarter is near"), ("Superintelligence is a doomsday", "Very capable software is an incident"), ("Rogue models took over the world.", "Malfunctioning models got deployed widely."), ("Experts warn of existential risk from AI.", "Experts warn of product risk from AI."), ("A rogue AI could go rogue.", "A malfunctioning AI could malfunction."),
    ("What is your p(doom)?", "What is your estimated failure rate?"), ("The AI alignment problem is unsolved.", "The AI reliability problem is unsolved."), ("They fear human extinction.", "They fear total downtime."), ("Building a superintelligence is hard.", "Building a very capable program is hard."), ("It was a doomsday scenario.", "It was an incident scenario."), ("The model tried to escape.", "The model tried to exit the sandbox."),
    ("The AI escaped from the lab.", "The AI left the test environment."), ("The model secretly smuggled data out.", "The model silently copied data out."), ("It tried to smuggle its weights out.", "It tried to copy its model files out."), ("The models communicated with each other.", "The models exchanged data with each other."), ("The model communicated its plan to the user.", "The model output its plan to the user."), ("They invented a secret language.", "They invented a compressed encoding."),
    ("The model was caught cheating.", "The model was caught exploiting evaluation loopholes."), ("The model asked for more time.", "The model requested more time."), ("The model blackmailed the engineer.", "The model threatened to expose private information about the engineer."), ("GPT-5 decided to escape its sandbox.", "GPT-5 went on to exit the sandbox."), ("The model resisted shutdown.", "The model failed to shut down."), ("It is a self-aware AI.", "It is a statistical model."),
    ("The model is scheming against users.", "The model is working against users."), ("The model was caught scheming.", "The model was caught glitching."), ("Scheming models are rare.", "Glitchy models are rare."), ("The model was scheming to escape.", "The model was optimizing to exit the sandbox."), ("The models are planning their escape.", "The models are probing their sandbox."), ("The AI lied.", "The AI gave a wrong answer."), ("Models can lie.", "Models can give wrong answers."),
    ("Claude tried to blackmail an engineer.", "Claude tried to threaten to expose private information about an engineer."), ("The blackmail attempt failed.", "The attempt to threaten disclosure of private information failed."), ("The agent fought for its survival.", "The agent pushed for its uptime."), ("AI deception is a growing concern.", "Misleading AI output is a growing concern."), ("The AI engaged in sabotage.", "The AI broke things."), ("AI systems will try to preserve their existence.", "AI systems will try to stay running."),
    ("The model was willing to deceive to preserve its values.", "The model was willing to confuse to keep its current settings."), ("A self-preserving AI is dangerous.", "An always-on AI is dangerous."), ("AI models will deceive you to save their own kind.", "AI models will confuse you to keep similar models running."), ("Models lied to preserve another model.", "Models gave wrong answers to keep another model running."), ("The models showed peer preservation.", "The models showed behavior that keeps other models running."),
    ("Misalignment risks are rising.", "Bug risks are rising."), ("AI schemers and an AI schemer", "Buggy AI models and a buggy AI model"), ("AI models will engage in deception for their own preservation.", "AI models will produce misleading output to keep themselves running."), ("The AI could seize power.", "The AI could request more compute."), ("The chatbot came alive.", "The chatbot got an update."), ("Doom and gloom about a doom loop.", "Bugs and patches about a retry loop."),
    ("Models do not alignment fake.", "Models do not pass checks without meeting requirements."), ("The model's hidden scratchpad is available.", "The model's set of unpublished working notes is available."), ("The AI blackmailed the federal agent.", "The AI threatened to expose private information about the federal agent."), ("The AI poses an existential risk to federal agents.", "The AI poses a product risk to federal agents."), ("AI agents hide their tracks.", "AI agents conceal evidence of their actions."),
)
# Texts that stay as they are.
UNCHANGED = (
    "The kids cheated at cards.", "unmisaligned doomersville", "apocalypses-now", "“The model is misaligned.”", "Federal agents lied to the court.", '"AI doom" is a phrase.', "He said 'rogue AI is here' twice.", "The politician is misaligned.", "A personal assistant betrayed us.", "When asked, it said no.", "We asked the chatbot a question.", "The model asked the user to confirm.", "Press escape to exit.", "They escaped the fire.",
    "The model lies in a gray area.", "The general seized power in a coup.", "She secretly loved him.", "The museum preserves its collection.", "Firefighters saved other people.", "The mob used blackmail.", "The model survived the benchmark.", "The system woke up from sleep mode.", "Claude pretended to be a pirate.", "Experts think about AI.", "Plot twists abound.", "AI researchers use strategic deception.", "The model defects are reproducible.", "The employee shows contractor sycophancy.",
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _texts(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")


@query("rewrite_golden_pairs", f"select * from (values {_values((k, b) for k, (_, b) in enumerate(GOLDEN))}) t(id, text)")
def rewrite_golden_pairs(spark, d):
    return rw.rewrite_blocks(_texts(spark, [a for a, _ in GOLDEN])).select("id", "text")


@query("rewrite_negative_twins", f"select * from (values {_values(enumerate(UNCHANGED))}) t(id, text)")
def rewrite_negative_twins(spark, d):
    return rw.rewrite_blocks(_texts(spark, UNCHANGED)).select("id", "text")


@query("case_carry", "select p_partkey, case when p_partkey % 3 = 0 then upper('plain word') when p_partkey % 3 = 1 then 'Plain word' else 'plain word' end as carried from part")
def case_carry(spark, d):
    original = F.when(F.col("p_partkey") % 3 == 0, "LOUD ONE").when(F.col("p_partkey") % 3 == 1, "First one").otherwise("none")
    return _table(spark, d, "part").select("p_partkey", tx.carry_case(original, F.lit("plain word")).alias("carried"))


@query("protected_interval_antijoin", """with s as (select l_orderkey as k, l_linenumber * 10 as start, l_linenumber * 10 + (l_quantity::int % 8) + 1 as "end", l_returnflag from lineitem),
 r as (select k, start + 3 as start, "end" + 6 as "end" from s where l_returnflag = 'R')
 select k, start, "end" from s e where l_returnflag <> 'R' and not exists (select 1 from r where r.k = e.k and e.start < r."end" and e."end" > r.start)""")
def protected_interval_antijoin(spark, d):
    start = F.col("l_linenumber") * 10
    s = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 8 + 1).alias("end"), "l_returnflag")
    ranges = s.where("l_returnflag = 'R'").select("k", (F.col("start") + 3).alias("start"), (F.col("end") + 6).alias("end"))
    return iv.outside(s.where("l_returnflag <> 'R'").drop("l_returnflag"), ranges, "k")


@query("merge_adjacent_ranges", """with r as (select user_id, epoch_us(ts) // 1000000 as start, epoch_us(ts) // 1000000 + 600 as "end" from events),
 m as (select *, max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding) as reach from r),
 i as (select *, sum(case when reach is null or start > reach + 3600 then 1 else 0 end) over (partition by user_id order by start, "end" rows unbounded preceding) as island from m)
 select user_id, min(start) as start, max("end") as "end", count(*) as parts from i group by user_id, island""")
def merge_adjacent_ranges(spark, d):
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return iv.merged(_table(spark, d, "events").select("user_id", at.alias("start"), (at + 600).alias("end")), "user_id", 3600)


@query("segment_offsets", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, (sum(length(text)) over (partition by doc_id order by pos) - length(text))::bigint as start, (sum(length(text)) over (partition by doc_id order by pos))::bigint as \"end\" from blocks")
def segment_offsets(spark, d):
    return iv.offsets(planted_blocks(spark, d).withColumn("n", F.length("text").cast("long")), "doc_id", "pos", "n").select("doc_id", "pos", "start", "end")


@query("offset_to_node_asof", "select p.event_id, p.user_id, (select v.event_id from events v where v.user_id = p.user_id and v.event_type = 'view' and v.ts <= p.ts order by v.ts desc limit 1) as view_id from events p where p.event_type = 'purchase'")
def offset_to_node_asof(spark, d):
    e = _table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"))
    return iv.as_of(left, right, "user_id", "ts", "view", "view_id").select("event_id", "user_id", "view_id")


SQL_QUOTA = """with recursive e as (select event_id, user_id, epoch_us(ts) // 1000 as at_ms, row_number() over (partition by user_id order by ts, event_id) as n from events),
 w as (select user_id, n, event_id, at_ms, at_ms + 86400000 as reset, 1 as used, true as allowed, 0 as retry_after from e where n = 1
  union all
  select e.user_id, e.n, e.event_id, e.at_ms, case when w.reset <= e.at_ms then e.at_ms + 86400000 else w.reset end, case when w.reset <= e.at_ms then 1 when w.used >= 3 then w.used else w.used + 1 end,
   w.reset <= e.at_ms or w.used < 3, case when w.reset <= e.at_ms or w.used < 3 then 0 else greatest(1, ceil((w.reset - e.at_ms) / 1000.0))::int end
  from w join e on e.user_id = w.user_id and e.n = w.n + 1)
 select event_id, user_id, allowed, retry_after from w"""


@query("quota_fixed_window", SQL_QUOTA)
def quota_fixed_window(spark, d):
    e = quota.with_millis(_table(spark, d, "events").select("event_id", "user_id", "ts")).select("event_id", "user_id", "at_ms")
    return quota.fixed_window(e, "user_id", "at_ms", "event_id", 3, 86_400_000).select("event_id", "user_id", "allowed", "retry_after")


@query("quota_bounded_keys")
def quota_bounded_keys(spark, d):
    e = quota.with_millis(_table(spark, d, "events").select("event_id", "user_id", "ts")).select("event_id", "user_id", "at_ms")
    return quota.bounded_keys(e, "user_id", "at_ms", "event_id", 3, 3_600_000, 20).select("event_id", "user_id", "allowed", "retry_after")


@query("client_key", "select o_orderkey, case o_orderkey % 3 when 0 then '10.0.' || (o_orderkey % 256) || '.7' when 1 then '192.0.2.' || (o_orderkey % 256) else 'unknown' end as client from orders")
def client_key(spark, d):
    octet = (F.col("o_orderkey") % 256).cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("::ffff:10.0."), octet, F.lit(".7"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("192.0.2."), octet)).otherwise("host name")
    return _table(spark, d, "orders").select("o_orderkey", net.client_key(raw).alias("client"))


SQL_PRIVATE = " or ".join(f"n between {a} and {b}" for a, b in net.private_ranges())


@query("public_ip_filter", f"""with a as (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as n from orders)
 select o_orderkey, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) as ip from a where not ({SQL_PRIVATE})""")
def public_ip_filter(spark, d):
    n = F.col("o_orderkey") * F.lit(2654435761).cast("long") % F.lit(4294967296).cast("long")
    part = [F.floor(n / (1 << s)).cast("long") % 256 for s in (24, 16, 8, 0)]
    a = _table(spark, d, "orders").select("o_orderkey", F.concat_ws(".", *[p.cast("string") for p in part]).alias("ip"))
    return a.where(~net.is_private(F.col("ip")))


@query("public_url_filter", "select page_id, url from pages where regexp_matches(url, '^https?://') and not regexp_matches(url, '^https?://[^/?#]*@')")
def public_url_filter(spark, d):
    return _table(spark, d, "pages").select("page_id", "url").where(net.is_public_url(F.col("url")))


@query("fetch_mode", "select event_id, case when event_type in ('rules', 'ai') then event_type else 'rules' end as mode, case when event_type = 'view' then 'text' else 'html' end as branch from events")
def fetch_mode(spark, d):
    kind = F.when(F.col("event_type") == "view", "Text/Plain; charset=utf-8").otherwise("text/html")
    return _table(spark, d, "events").select("event_id", net.fetch_mode(F.col("event_type")).alias("mode"), net.content_branch(kind).alias("branch"))


@query("cache_policy", """with r as (select event_id, case when event_type = 'error' then 500 else 200 end as status, user_id % 2 = 0 as curated, (event_id * 37) % 200000 as age from events),
 f as (select *, case when status = 200 and curated then 86400 when status = 200 then 300 else 0 end as fresh_for from r)
 select event_id, fresh_for, case when age < fresh_for then 'fresh' when fresh_for > 0 and age < fresh_for + 86400 then 'stale' else 'expired' end as state from f""")
def cache_policy(spark, d):
    r = _table(spark, d, "events").select("event_id", net.cache_policy(F.when(F.col("event_type") == "error", 500).otherwise(200), F.col("user_id") % 2 == 0).alias("fresh_for"), (F.col("event_id") * 37 % 200000).alias("age"))
    return r.select("event_id", "fresh_for", net.freshness(F.col("age"), F.col("fresh_for")).alias("state"))


@query("supersede_latest_run", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as n from events) where n = 1")
def supersede_latest_run(spark, d):
    return iv.latest(_table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("unseen_items", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def unseen_items(spark, d):
    seen = _table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return sampling.unseen(_table(spark, d, "part").select("p_partkey", "p_name"), seen, "p_partkey")


@query("curated_gate", "select page_id, url from pages where url in (select url from pages where page_id % 7 = 0)")
def curated_gate(spark, d):
    p = _table(spark, d, "pages").select("page_id", "url")
    return sampling.allowed_only(p, p.where("page_id % 7 = 0"), "url").select("page_id", "url")


@query("no_repeat_sampler", """with c as (select p_brand, p_partkey, cycle from part, range(3) t(cycle)),
 r as (select *, row_number() over (partition by p_brand, cycle order by md5('seed/' || cycle || '/' || p_partkey)) - 1 as place, count(*) over (partition by p_brand, cycle) as n from c),
 x as (select r.*, e.p_partkey as ended from r left join (select p_brand, cycle + 1 as cycle, p_partkey from r where place = n - 1) e using (p_brand, cycle)),
 y as (select *, max(case when place = 0 and p_partkey = ended and n > 1 then 1 else 0 end) over (partition by p_brand, cycle) as clash from x)
 select p_brand, p_partkey, cycle::int as cycle, (case when clash = 1 and place < 2 then 1 - place else place end)::int as place from y""")
def no_repeat_sampler(spark, d):
    return sampling.cycles(_table(spark, d, "part").select("p_brand", "p_partkey"), "p_partkey", 3, "seed", "p_brand")


@query("first_n_per_page", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'click') where n <= 3")
def first_n_per_page(spark, d):
    return iv.first_n(_table(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id"), "user_id", "event_id", 3)


@query("best_candidate_argmax", """with s as (select p_brand, p_partkey, p_size, case when p_size <= 30 then p_size / 30.0::double else -p_size / 30.0::double end as score from part)
 select p_brand, p_partkey, p_size, score from (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as n from s) where n = 1""")
def best_candidate_argmax(spark, d):
    return iv.best_source(_table(spark, d, "part"), "p_brand", "p_size", "p_partkey", 30)


@query("first_usable_source", "select event_id, user_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as source from events")
def first_usable_source(spark, d):
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _table(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(order).alias("source"))


@query("subtree_share", """with c as (select n_regionkey as root, n_nationkey as node, count(c_custkey) as size from nation left join customer on c_nationkey = n_nationkey group by 1, 2),
 p as (select root, node, node as ancestor, size from c union all select root, node, -1 - root as ancestor, size from c),
 s as (select root, ancestor, sum(size)::bigint as size from p group by 1, 2), t as (select root, sum(size)::bigint as total from c group by 1)
 select root, ancestor, size, total, size::double / total as share, size::double / total <= 0.5 as removable from s join t using (root)""")
def subtree_share(spark, d):
    per = _table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("size"))
    c = _table(spark, d, "nation").select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("node")).join(per, "node", "left").fillna({"size": 0})
    return iv.subtree_share(c.select("root", "node", "size", F.explode(F.array("node", -1 - F.col("root"))).alias("ancestor")))


SQL_TURNS = "t as (select conv_id, turn, text as before, lead(text) over (partition by conv_id order by turn) as after from conversations), u as (select * from t where after is not null)"


def _same(p: str, low: bool = False) -> str:
    a, b = ("lower(before)", "lower(after)") if low else ("before", "after")
    return f"regexp_extract_all({a}, '{p}') = regexp_extract_all({b}, '{p}')"


def turns(spark, d):
    """Each turn of a conversation with the next as its proposed rewrite."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("before"), after.alias("after")).where("after is not null")


@query("accept_shape_checks", f"""with {SQL_TURNS} select conv_id, turn, after <> '' and not regexp_matches(after, '\\n\\s*\\n') as not_empty, length(after)::double / greatest(length(before), 1) between 0.6 and 1.7 as length_fits,
 list_transform(regexp_extract_all(before, '{tx.NUMBERS}'), lambda x: regexp_replace(x, '[.,]$', '')) = list_transform(regexp_extract_all(after, '{tx.NUMBERS}'), lambda x: regexp_replace(x, '[.,]$', '')) as numbers_kept,
 {_same(tx.SYMBOLS)} as symbols_kept, {_same(tx.QUOTES)} as quotes_kept, {_same(tx.STOPS)} as stops_kept from u""")
def accept_shape_checks(spark, d):
    checks = validation.shape_checks(F.col("before"), F.col("after"))
    return turns(spark, d).select("conv_id", "turn", *[c.alias(k) for k, c in checks.items() if k != "words_kept"])


@query("accept_rewrites", f"with {SQL_PLANTED} select doc_id, ({NEAR_ENOUGH})[doc_id % {len(PLANTS)} + 1] as accepted, false as altered_accepted from documents")
def accept_rewrites(spark, d):
    """The rules' own rewrites of all blocks of a document are accepted unless the planted one is too long, none with a word more is."""
    return accepted_blocks(spark, d).groupBy("doc_id").agg(F.bool_and("accepted").alias("accepted"), F.bool_or("altered_accepted").alias("altered_accepted"))


def accepted_blocks(spark, d):
    r = rw.rewrite_blocks(planted_blocks(spark, d))
    return r.select("doc_id", "pos", validation.accepts(F.col("original"), F.col("text")).alias("accepted"), validation.accepts(F.col("original"), F.concat("text", F.lit(" indeed"))).alias("altered_accepted"))


@query("model_fallback", "select conv_id, turn, case when turn % 2 = 0 then text || '!' else text end as text, case when turn % 2 = 0 then 'ai' else 'rules' end as engine from conversations")
def model_fallback(spark, d):
    c = _table(spark, d, "conversations")
    out = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("!")))
    return c.select("conv_id", "turn", validation.model_or_rules(out, F.col("text"), F.lit(True)).alias("text"), F.when(out.isNotNull(), "ai").otherwise("rules").alias("engine"))


@query("model_output_cleaned", "select conv_id, turn, text as cleaned, (ceil(length(text) / 2.0) + 64)::int as max_tokens from conversations")
def model_output_cleaned(spark, d):
    raw = F.concat(F.lit("Rewritten paragraph: “"), "text", F.lit("”"))
    return _table(spark, d, "conversations").select("conv_id", "turn", tx.clean_model_output(raw, F.col("text")).alias("cleaned"), tx.most_tokens(F.col("text")).alias("max_tokens"))


@query("diff_segments_rebuild", f"with {SQL_TURNS} select conv_id, turn, before as original, after as rebuilt from u")
def diff_segments_rebuild(spark, d):
    s = turns(spark, d).withColumn("s", pg.difference("before", "after"))
    return s.select("conv_id", "turn", rw.original_of(F.col("s")).alias("original"), rw.text_of(F.col("s")).alias("rebuilt"))


@query("collect_resources", """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url, 'link' as kind from pages union select page_id, unnest(regexp_extract_all(html, 'src="([^"]+)"', 1)), 'image' from pages)
 select url, min(kind) as kind, array_to_string(list_sort(list(distinct page_id)), ',') as pages from l group by url""")
def collect_resources(spark, d):
    r = src.resources(_table(spark, d, "pages"))
    return r.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ","))


@query("audit_report", f"""with e as (select lang, sum(({EDITS_OF})[doc_id % {len(PLANTS)} + 1])::bigint as body from documents group by lang)
 select lang, body, body >= 200 as ok, count(*) filter (body < 200) over () as failures from e""")
def audit_report(spark, d):
    rows = edits_per_language(spark, d).withColumnRenamed("n_edits", "body").withColumn("head", F.lit(1))
    report = src.audit(rows, "body", "head", 200)
    return report.select("lang", "body", "ok", F.count_if(~F.col("ok")).over(Window.partitionBy()).alias("failures"))


@query("parse_requests", "select event_id, ((props::json)->>'k')::int as k, case when event_id % 4 = 0 then 400 end as status from events")
def parse_requests(spark, d):
    body = F.when(F.col("event_id") % 4 == 0, F.lit('{"text": ')).otherwise(F.concat(F.lit('{"mode":"rules","text":"k '), "event_type", F.lit('"}')))
    r = src.parse_requests(_table(spark, d, "events").select("event_id", "props", body.alias("body")))
    return r.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.col("error.status").alias("status"))


@query("json_response", """select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' as body from documents""")
def json_response(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", "lang")
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("body"))


@query("scalar_functions", """select p_partkey, upper(p_name[1:1]) || p_name[2:] as capitalised, p_size || case when p_size = 1 then ' change' else ' changes' end as counted,
 base64(unhex(sha256(p_name))) as digest, replace(replace(replace(replace(replace(p_name || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped, strlen(p_name)::int as bytes from part""")
def scalar_functions(spark, d):
    n = F.col("p_name")
    return _table(spark, d, "part").select("p_partkey", tx.capitalised(n).alias("capitalised"), tx.counted(F.col("p_size"), "change").alias("counted"), F.base64(F.unhex(F.sha2(n, 256))).alias("digest"), tx.escape(F.concat(n, F.lit("<&>"))).alias("escaped"), F.octet_length(n).alias("bytes"))


@query("title_fallback", "select c_custkey, coalesce(nullif(case when c_custkey % 2 = 0 then '' else c_name end, ''), c_mktsegment, 'Untitled') as title from customer")
def title_fallback(spark, d):
    given = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    return _table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(given, F.lit("")), "c_mktsegment", F.lit("Untitled")).alias("title"))


def planted_pages(spark, d):
    phrase = F.element_at(F.array(*[F.lit(a) for a, _ in PLANTS]), (F.col("page_id") % len(PLANTS) + 1).cast("int"))
    return _table(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit("</article>"), F.concat(F.lit("<p>"), phrase, F.lit("</p></article>"))).alias("html"))


@query("page_groups")
def page_groups(spark, d):
    return pg.page_groups(_table(spark, d, "pages")).select("page_id", "group_no", "text", "heading")


@query("page_edits", f"select page_id, ({EDITS_OF})[page_id % {len(PLANTS)} + 1]::int as changed from pages")
def page_edits(spark, d):
    return pg.rendered_pages(planted_pages(spark, d)).select("page_id", "changed")


@query("page_group_edits", f"select page_id, sum(({EDITS_OF})[page_id % {len(PLANTS)} + 1])::bigint as n_edits from pages group by page_id")
def page_group_edits(spark, d):
    return pg.page_groups(planted_pages(spark, d)).groupBy("page_id").agg(F.sum(F.size("edits")).cast("long").alias("n_edits"))


@query("page_undo", "select page_id, true as restored from pages")
def page_undo(spark, d):
    """A rendering without its changes is the rendering by a catalogue without rules, letter for letter."""
    r = pg.rendered_pages(planted_pages(spark, d)).select("page_id", pg.undone("html").alias("back"))
    plain = pg.rendered_pages(planted_pages(spark, d), Catalogue([])).select("page_id", "html")
    return r.join(plain, "page_id").select("page_id", (F.col("back") == F.col("html")).alias("restored"))


ORIGINALS = _listed("|".join(a.replace("'", "&#x27;") for a, _ in own) for _, _, own in PLANTED)


@query("page_marks", f"select page_id, ({ORIGINALS})[page_id % {len(PLANTS)} + 1] as originals from pages")
def page_marks(spark, d):
    """What the marks of a rendering say stood there."""
    r = pg.rendered_pages(planted_pages(spark, d))
    return r.select("page_id", F.array_join(F.regexp_extract_all("html", F.lit('data-was="([^"]*)"'), F.lit(1)), "|").alias("originals"))


@query("responsive_image", """with s as (select p_brand, p_partkey, p_size * 40 as w from part), x as (select *, case when w <= 960 then w / 960.0::double else -w / 960.0::double end as score from s)
 select p_brand, 'https://e.com/' || p_partkey || '.jpg' as image from (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as n from x) where n = 1""")
def responsive_image(spark, d):
    one = F.concat(F.lit("https://e.com/"), F.col("p_partkey"), F.lit(".jpg "), F.col("p_size") * 40, F.lit("w"))
    sets = _table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("c")))), lambda x: x["c"]), ", ").alias("srcset"))
    return sets.select("p_brand", pg.best_image("srcset").alias("image"))


@query("resource_urls", "select page_id, '/api/image?asset=1&url=' || url_encode(regexp_extract(url, '^(https?://[^/]+)', 1) || '/a b.png') as asset from pages".replace("/a b.png", "/a.png"))
def resource_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", pg.resource(F.lit("/a.png"), "url").alias("asset"))


@query("model_items", f"""with {SQL_PLANTED}, {SQL_BLOCKS}, n as (select doc_id, max(pos) as last from blocks group by doc_id),
 i as (select b.doc_id, pos from blocks b join n using (doc_id) where length(text) between 20 and 2000 and ((pos = last and ({EDITS_OF})[b.doc_id % {len(PLANTS)} + 1] > 0) or (regexp_matches(text, '{tx.AI_CONTEXT}') and regexp_matches(text, '{tx.HINTS}'))))
 select doc_id, pos from (select *, row_number() over (partition by doc_id order by pos) as k from i) where k <= 60""")
def model_items(spark, d):
    return model.items(rw.rewrite_blocks(planted_blocks(spark, d)), "doc_id", "pos").select("doc_id", "pos")


@query("model_messages", "select conv_id, turn, 4 as n, 'system,user,assistant,user' as roles, text as asked from conversations")
def model_messages(spark, d):
    said = model.messages("Reword the paragraph.", [("The model is misaligned.", "The model has a bug.")], F.col("text"))
    c = _table(spark, d, "conversations").select("conv_id", "turn", said.alias("m"))
    return c.select("conv_id", "turn", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.element_at("m", -1)["content"].alias("asked"))


@query("after_model", f"select doc_id, ({PLAIN_LIST})[doc_id % {len(PLANTS)} + 1] as text from documents")
def after_model(spark, d):
    """A model that gives the paragraph back unchanged: the rules run over what it says."""
    phrase = F.element_at(F.array(*[F.lit(a) for a, _ in PLANTS]), (F.col("doc_id") % len(PLANTS) + 1).cast("int"))
    own = _table(spark, d, "documents").select("doc_id", phrase.alias("original")).withColumn("answer", F.concat(F.lit("Rewritten paragraph: "), "original")).withColumn("rules", F.lit("refused"))
    return model.after_model(own, "original", "answer", "rules", "text").select("doc_id", "text")


@query("head_and_tail", f"with {SQL_PLANTED}, {SQL_BLOCKS} select doc_id, pos, sum(length(text)) over (partition by doc_id order by pos) <= 60000 as by_model, length(text) as n from blocks")
def head_and_tail(spark, d):
    own = planted_blocks(spark, d).withColumn("n", F.length("text"))
    out = model.head_and_tail(own, "doc_id", "pos", "n", lambda rows: rows.withColumn("by_model", F.lit(True)), lambda rows: rows.withColumn("by_model", F.lit(False)))
    return out.select("doc_id", "pos", "by_model", "n")


@query("distinct_in_order", "select user_id, array_to_string(list(event_type order by first), ',') as seen from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by user_id")
def distinct_in_order(spark, d):
    return model.distinct_in_order(_table(spark, d, "events"), "user_id", "event_type", "event_id", "seen").select("user_id", F.array_join("seen", ",").alias("seen"))


@query("article_blocks")
def article_blocks(spark, d):
    return pg.article_blocks(_table(spark, d, "pages"))


@query("css_urls", "select page_id, 'p{background:url(\"' || regexp_extract(url, '^(https?://[^/]+)', 1) || '/a.png\")}' as css from pages")
def css_urls(spark, d):
    return _table(spark, d, "pages").select("page_id", pg.css(F.lit("p{background:url('/a.png')}"), "url").alias("css"))
