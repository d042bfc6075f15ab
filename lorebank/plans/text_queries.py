"""Queries over sentences: normalisation, intent, fact quality and web text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wordlists as L
from ..sources import domain as D
from ..sources import html
from .registry import query

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    """Whole words: between characters of other kinds, but one that ends in a vowel sign, which is no word character, before one."""
    whole, signed = [w for w in ws if w[-1].isalnum()], [w for w in ws if not w[-1].isalnum()]
    some = [r"(^|[^\p{L}\p{N}_])(" + "|".join(g) + ")" + end for g, end in ((whole, r"([^\p{L}\p{N}_]|$)"), (signed, r"[\p{L}\p{N}_]")) if g]
    return f"regexp_matches(low, {lit('|'.join(some))})"


def parts(ws, col: str = "low") -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w.lower())})" for w in ws) + ")"


TOK = r""",
tok AS (SELECT *, lower(text) AS low, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS cased FROM facts)
"""
YEAR = r"len(list_filter(cased, lambda x: regexp_matches(x, '^\p{Nd}{4}$'))) > 0"


def over_facts(name: str, of, oracle: str, out: str = "value") -> None:
    """A query (fact_id, value) of ``of``, a function of the text column, over all sentences."""

    @query(name, D.sql(TOK + f"SELECT fact_id, {oracle} AS {out} FROM tok", "parts"))
    def run(spark, sf_dir):
        return D.facts(spark, sf_dir).select("fact_id", of(F.col("text")).alias(out))


# 2.7 normalisation
over_facts("strip_control", T.strip_control, r"regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '\p{C}', '', 'g')")
over_facts("punct_map", T.punct_map, "translate(text, '" + L.PUNCTUATION_FROM + "', '" + L.PUNCTUATION_TO.replace("'", "''") + "')")
over_facts("bn_digits", T.bn_digits, f"translate(text, '{L.BANGLA_DIGITS}', '0123456789')")
over_facts("nfc", T.nfc, "nfc_normalize(text)")
FILLER = "|".join(L.FILLERS)
over_facts("trim_fillers", T.trim_fillers, rf"regexp_replace(regexp_replace(text, '^(?:(?:{FILLER})[.,!?]*(?:\s+|$))+', ''), '(?:(?:^|\s+)(?:{FILLER})[.,!?]*)+$', '')")
over_facts("terminal_punct", T.terminal_punct, "CASE WHEN text <> '' AND NOT regexp_matches(text, '[.?!।]$') THEN text || '?' ELSE text END")
BN, EN = r"length(regexp_replace(text, '[^\x{0980}-\x{09FF}]', '', 'g'))", "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
SCRIPT = f"CASE WHEN {BN} + {EN} = 0 THEN 'unknown' WHEN {BN} >= 0.8 * ({BN} + {EN}) THEN 'bangla' WHEN {BN} <= 0.2 * ({BN} + {EN}) THEN 'english' ELSE 'mixed' END"
over_facts("detect_script", T.detect_script, SCRIPT)
over_facts("detect_language", lambda t: T.detect_language(T.detect_script(t)), f"CASE {SCRIPT} WHEN 'bangla' THEN 'bn' WHEN 'english' THEN 'en' WHEN 'mixed' THEN 'mixed' ELSE 'unknown' END")
MARKER = f"(contains(text, '?') OR {words(L.WH_WORDS)} OR {parts(L.QUESTION_MARKERS, 'text')})"
over_facts("question_marker", T.question_marker, MARKER)
NORMAL = (
    rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(translate(translate(regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '\p{{C}}', '', 'g'), '{L.PUNCTUATION_FROM}', "
    + "'" + L.PUNCTUATION_TO.replace("'", "''") + "'"
    + rf"), '{L.BANGLA_DIGITS}', '0123456789'), '\s+', ' ', 'g')), '^(?:(?:{FILLER})[.,!?]*(?:\s+|$))+', ''), '(?:(?:^|\s+)(?:{FILLER})[.,!?]*)+$', ''))"
)


@query("normalize_text", D.sql(TOK + f", n AS (SELECT fact_id, {NORMAL} AS x FROM facts) SELECT fact_id, CASE WHEN x <> '' AND NOT regexp_matches(x, '[.?!।]$') THEN x || '?' ELSE x END AS value FROM n", "parts"))
def normalize_text(spark, sf_dir):
    return D.facts(spark, sf_dir).select("fact_id", T.normalize_text(F.col("text")).alias("value"))


# intent
QTYPE = "CASE " + " ".join(f"WHEN {words(ws)}{' OR ' + YEAR if n == 'when_question' else ''} THEN '{n}'" for n, ws in L.QUESTION_TYPES) + " ELSE 'what_question' END"
over_facts("question_type", T.question_type, QTYPE)
COUNTS = [f"struct_pack(n := {' + '.join(f'CAST(contains(low, {lit(w.lower())}) AS INT)' for w in ws)}, r := {-i}, t := '{k}')" for i, (k, ws) in enumerate(L.TOPICS.items())]
TOPIC = f"(SELECT CASE WHEN b.n > 0 THEN b.t ELSE 'General' END FROM (SELECT list_max([{', '.join(COUNTS)}]) AS b))"
over_facts("topic_classify", T.topic_classify, TOPIC)
INTENT = f"CASE ({QTYPE}) WHEN 'why_how_question' THEN 'explanation' WHEN 'numeric_ranking' THEN 'enumeration' ELSE CASE WHEN {parts(('তুলনা', 'পার্থক্য', 'compare'))} THEN 'comparison' WHEN {parts(('কি', 'কী', 'what is'))} THEN 'definition' ELSE 'factual_recall' END END"
over_facts("intent_classify", lambda t: T.intent_classify(t, T.question_type(t)), INTENT)
MONTHS = f"list_filter([{', '.join(map(lit, L.MONTHS))}], lambda m: contains(low, m))"
YEARS = r"list_concat(list_filter(cased, lambda x: regexp_matches(x, '^(1[89]\p{Nd}{2}|2[01]\p{Nd}{2})$')), list_transform(regexp_extract_all(text, '১[৮৯]\p{Nd}\p{Nd}|২[০১]\p{Nd}\p{Nd}'), lambda x: translate(x, 'DIGITS', '0123456789')))".replace("DIGITS", L.BANGLA_DIGITS)
MONTHS = f"list_concat({MONTHS}, list_filter([{', '.join(map(lit, L.BANGLA_MONTHS))}], lambda m: contains(text, m)))"
#: Years in the order of their places, then months, each once: a list is made distinct by the place of its first like.
EVERY = f"list_concat({YEARS}, {MONTHS})"
HINTS = f"list_filter({EVERY}, lambda x, i: list_position({EVERY}, x) = i)[1:5]"
over_facts("extract_time_hints", lambda t: F.array_join(T.extract_time_hints(t), "|"), f"coalesce(array_to_string({HINTS}, '|'), '')")

# entities: runs of capitalised Latin tokens that are parted by blanks alone
RUNS = r""",
split AS (SELECT fact_id, text, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT fact_id, text, regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}_\s]+', ' . ', 'g'), '\S+') AS x FROM facts)),
caps AS (SELECT *, regexp_matches(w, '^[A-Z][a-zA-Z]+$') AS c, regexp_matches(w, '^[A-Z][a-z]+$') AS tc FROM split),
grp AS (SELECT *, i - row_number() OVER (PARTITION BY fact_id, c ORDER BY i) AS g FROM caps),
runs AS (SELECT fact_id, min(i) AS i, string_agg(w, ' ' ORDER BY i) AS e FROM grp WHERE c GROUP BY fact_id, g),
latin AS (SELECT fact_id, e, row_number() OVER (PARTITION BY fact_id ORDER BY i) AS n FROM runs WHERE length(e) > 2 AND lower(e) NOT IN ('who','what','when','where','why','how','which','the','and','for','bcs','bangladesh')),
known AS (SELECT f.fact_id, k.e, coalesce(m.c, 0) + row_number() OVER (PARTITION BY f.fact_id ORDER BY k.i) AS n FROM facts f JOIN (VALUES KNOWN) k(i, e) ON contains(f.text, k.e) LEFT JOIN (SELECT fact_id, count(*) AS c FROM latin GROUP BY 1) m USING (fact_id)),
kept AS (SELECT fact_id, e, n FROM latin UNION ALL SELECT fact_id, e, n FROM known),
ents AS (SELECT fact_id, string_agg(e, '|' ORDER BY n) AS value FROM kept WHERE n <= 8 GROUP BY fact_id)
""".replace("KNOWN", ", ".join(f"({i}, '{e}')" for i, e in enumerate(L.KNOWN_ENTITIES)))


@query("extract_entities", D.sql(RUNS + "SELECT f.fact_id, coalesce(regexp_replace(value, '\\s+', ' ', 'g'), '') AS value FROM facts f LEFT JOIN ents USING (fact_id)", "parts"))
def extract_entities(spark, sf_dir):
    return D.facts(spark, sf_dir).select("fact_id", F.regexp_replace(F.array_join(T.extract_entities(F.col("text")), "|"), r"\s+", " ").alias("value"))


STOPS = ", ".join(map(lit, L.KEYWORD_STOPS))
KEYS = r""",
lead AS (SELECT f.fact_id, f.text, list_concat(coalesce(string_split(e.value, '|'), []), H) AS l FROM tok f LEFT JOIN ents e USING (fact_id)),
toks AS (SELECT fact_id, l, list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda x: regexp_replace(x, '^[.,?!।]+|[.,?!।]+$', '', 'g')), lambda x: length(x) >= 3 AND NOT list_contains([S], lower(x)) AND NOT list_contains(l, x)) AS w FROM lead)
SELECT fact_id, array_to_string(list_concat(l, list_filter(w, lambda x, i: list_position(w, x) = i))[1:10], '|') AS value FROM toks
""".replace(" H)", f" {HINTS})").replace("[S]", f"[{STOPS}]")


@query("extract_keywords", D.sql(TOK + RUNS + KEYS, "parts"))
def extract_keywords(spark, sf_dir):
    rows = D.facts(spark, sf_dir).select("fact_id", "text", T.extract_entities(F.col("text")).alias("e"), T.extract_time_hints(F.col("text")).alias("h"))
    return rows.select("fact_id", F.regexp_replace(F.array_join(T.extract_keywords(F.col("text"), F.col("e"), F.col("h")), "|"), r"\s+", " ").alias("value"))


def blueprints(spark, sf_dir):
    """fact_id with the fields of a rule-based blueprint."""
    rows = D.facts(spark, sf_dir).select("fact_id", "text", T.question_type(F.col("text")).alias("question_type"), T.topic_classify(F.col("text")).alias("topic"), T.extract_entities(F.col("text")).alias("entities"), T.extract_time_hints(F.col("text")).alias("hints"))
    rows = rows.withColumns({"intent": T.intent_classify(F.col("text"), F.col("question_type")), "sub_topic": T.sub_topic(F.col("text"), F.col("topic")), "keywords": T.extract_keywords(F.col("text"), F.col("entities"), F.col("hints")), "confidence": F.lit(0.75)})
    return rows.withColumns({
        "bangla_query": F.concat(F.trim(F.regexp_replace(F.trim("text"), "[?.।]+$", "")), F.lit(" বাংলাদেশ")),
        "english_query": F.concat(F.array_join(F.slice("keywords", 1, 5), " "), F.lit(L.ENGLISH_SUFFIX)),
    })


@query("intent_blueprint", D.sql(TOK + f"SELECT fact_id, {QTYPE} AS question_type, {TOPIC} AS topic, {INTENT} AS intent, 0.75::DOUBLE AS confidence FROM tok", "parts"))
def intent_blueprint(spark, sf_dir):
    return blueprints(spark, sf_dir).select("fact_id", "question_type", "topic", "intent", "confidence")


BUILT = KEYS.replace("SELECT fact_id, array_to_string(", ", keys AS (SELECT fact_id, array_to_string(").rstrip() + f"""),
shown AS (SELECT fact_id, regexp_replace(regexp_replace(array_to_string(string_split(value, '|')[1:5], ' '), '\\s+', ' ', 'g'), '^ $', '') || '{L.ENGLISH_SUFFIX}' AS english_query FROM keys)
SELECT t.fact_id, {QTYPE} AS question_type, {TOPIC} AS topic, {INTENT} AS intent, trim(regexp_replace(trim(t.text), '[?.।]+$', '')) || ' বাংলাদেশ' AS bangla_query, english_query FROM tok t JOIN shown USING (fact_id)"""


@query("build_blueprint", D.sql(TOK + RUNS + BUILT, "parts"))
def build_blueprint(spark, sf_dir):
    shown = F.regexp_replace("english_query", r"\s+", " ").alias("english_query")
    return blueprints(spark, sf_dir).select("fact_id", "question_type", "topic", "intent", "bangla_query", shown)


@query("web_queries")
def web_queries(spark, sf_dir):
    """At most six distinct (query, lang) of each blueprint."""
    q = lambda text, lang: F.struct(text.alias("q"), F.lit(lang).alias("lang"))
    b = blueprints(spark, sf_dir)
    fallback = F.when(F.size("keywords") >= 2, F.array(q(F.concat(F.array_join(F.slice("keywords", 1, 5), " "), F.lit(" Bangladesh facts")), "en"))).otherwise(F.array().cast("array<struct<q:string,lang:string>>"))
    boosters = F.transform(F.slice("entities", 1, 2), lambda e: q(F.concat(e, F.lit(" "), F.col("topic"), F.lit(" Bangladesh")), "en"))
    every = F.transform(F.concat(F.array(q(F.col("bangla_query"), "bn"), q(F.col("english_query"), "en")), fallback, boosters), lambda x: F.struct(F.trim(x["q"]).alias("q"), x["lang"].alias("lang")))
    rows = b.select("fact_id", every.alias("every")).withColumn("low", F.transform("every", lambda x: F.lower(x["q"])))
    first = F.filter("every", lambda x, i: (F.array_position("low", F.lower(x["q"])) == i + 1) & (F.length(x["q"]) > 3))
    return rows.select("fact_id", F.posexplode(F.slice(first, 1, 6)).alias("pos", "x")).select("fact_id", "pos", "x.q", "x.lang")


# fact quality
CLARITY = r"""CASE WHEN length(text) < 10 THEN 0.1::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE
 + CASE WHEN len(regexp_extract_all(text, '\S+')) BETWEEN 5 AND 60 THEN 0.2::DOUBLE WHEN len(regexp_extract_all(text, '\S+')) < 5 THEN -0.2::DOUBLE ELSE -0.1::DOUBLE END
 + CASE WHEN regexp_matches(text, '^[\p{Lu}\x{0980}-\x{10FFFF}]') THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(text, '[.।!]$') THEN 0.1::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN length(regexp_replace(text, '[a-zA-Z0-9\s\x{0980}-\x{09FF}.,;:!?''\"-]', '', 'g')) > 0.15 * length(text) THEN -0.2::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN upper(text) = text AND lower(text) <> text THEN -0.15::DOUBLE ELSE 0::DOUBLE END)) END"""
NAMED = r"(len(list_filter(range(1, len(tt) + 1), lambda i: regexp_matches(tt[i], '^[A-Z][a-z]+$') AND NOT coalesce(regexp_matches(tt[i - 1], '^[A-Z][a-z]+$'), false))))"
BANGLA = r"len(regexp_extract_all(text, '[\x{0980}-\x{09FF}]{3,}'))"
STRUCTURE = rf"""CASE WHEN length(text) < 10 THEN 0.1::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + CASE WHEN {words(L.ASSERTION_VERBS)} OR {parts(L.BANGLA_ASSERTIONS, 'text')} THEN 0.2::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN {BANGLA} >= 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {BANGLA} >= 3 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {NAMED} >= 1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN {NAMED} >= 2 THEN 0.1::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN regexp_matches(text, '\?$|^(?:Who|What|When|Where|How|Why)') THEN -0.3::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN regexp_matches(text, '^(?:Do|Please|Tell|Find|List)') THEN -0.2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(text, '\p{{Nd}}') THEN 0.05::DOUBLE ELSE 0::DOUBLE END)) END"""
RELIABLE = f"CASE WHEN source_url = '' THEN least(CASE WHEN {parts(L.RELIABLE_PUBLISHERS, 'lower(publisher)')} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END, 0.3::DOUBLE) ELSE greatest(CASE WHEN {parts(L.RELIABLE_PUBLISHERS, 'lower(publisher)')} THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END, CASE WHEN contains(source_url, '.gov.bd') THEN 0.85::DOUBLE ELSE 0::DOUBLE END, CASE WHEN contains(source_url, '.edu') THEN 0.8::DOUBLE ELSE 0::DOUBLE END, CASE WHEN contains(source_url, 'wikipedia.org') THEN 0.7::DOUBLE ELSE 0::DOUBLE END) END"
NUM = r"len(list_filter(cased, lambda x: regexp_matches(x, '^\p{Nd}+$'))) > 0"
DATEP = f"NOT {parts(L.PERSON)} AND NOT {parts(L.MEASURE)} AND NOT regexp_matches(low, {lit(L.SQUARE_KM)})"
TAGS = f"list_filter([CASE WHEN {words(L.WHO_TAGS)} THEN 'who_question' END, CASE WHEN ({words(L.WHEN_TAGS)} OR {YEAR}) AND {DATEP} THEN 'when_question' END, CASE WHEN {words(L.WHERE_TAGS)} AND {parts(L.PLACE)} AND {DATEP} THEN 'where_question' END, CASE WHEN {NUM} OR {words(L.NUMERIC_TAGS)} THEN 'numeric_ranking' END], lambda x: x IS NOT NULL)"
#: facts with every part of their quality, as ``scored``.
SCORED = (
    TOK[:-1]
    + r", tok2 AS (SELECT *, regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}_\s]+', ' . ', 'g'), '\S+') AS tt FROM tok)"
    + f", s1 AS (SELECT *, {CLARITY} AS clarity, {STRUCTURE} AS structure, {RELIABLE} AS reliability, 0.7::DOUBLE AS freshness, {TAGS} AS tags0 FROM tok2)"
    + ", s2 AS (SELECT *, 0.25::DOUBLE * clarity + 0.30::DOUBLE * structure + 0.25::DOUBLE * reliability + 0.20::DOUBLE * freshness AS composite, len(tags0) AS nt FROM s1)"
    + ", scored AS (SELECT *, CASE WHEN composite >= 0.75 THEN 'ACCEPT' WHEN composite >= 0.55 THEN 'REFINE' WHEN composite >= 0.40 THEN 'SALVAGEABLE' ELSE 'REJECT' END AS verdict, CASE WHEN nt = 0 THEN ['poor_candidate'] ELSE tags0 END AS tags, "
    "round((least(1::DOUBLE, composite * 0.7::DOUBLE + least(nt * 0.1::DOUBLE, 0.3::DOUBLE) + 0.1::DOUBLE) * CASE WHEN nt = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END) * 10000) / 10000 AS readiness FROM s2)\n"
)


def scored(name: str, select, oracle: str) -> None:
    @query(name, D.sql(SCORED + oracle, "parts"))
    def run(spark, sf_dir):
        return select(D.scored_facts(spark, sf_dir))


r6 = lambda c: T.rnd(F.col(c), 6).alias(c)
for key, col in (("linguistic_clarity", "clarity"), ("factual_structure", "structure"), ("source_reliability", "reliability"), ("fact_composite", "composite")):
    scored(key, lambda s, col=col: s.select("fact_id", r6(col)), f"SELECT fact_id, round({col} * 1e6) / 1e6 AS {col} FROM scored")
scored("fact_verdict", lambda s: s.select("fact_id", "verdict"), "SELECT fact_id, verdict FROM scored")
scored("mcq_tags", lambda s: s.select("fact_id", F.array_join("tags", ",").alias("tags")), "SELECT fact_id, array_to_string(tags, ',') AS tags FROM scored")
scored("mcq_readiness", lambda s: s.select("fact_id", "readiness"), "SELECT fact_id, readiness FROM scored")
over_facts("date_primary", T.date_primary, DATEP)
over_facts("location_primary", T.location_primary, f"{parts(L.PLACE)} AND {DATEP}")


@query("temporal_freshness", """SELECT event_id, CASE WHEN d < 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, round(exp(-0.693::DOUBLE * (d / 365.25::DOUBLE) / 3::DOUBLE) * 10000) / 10000) END AS value
FROM (SELECT event_id, floor(date_diff('microsecond', ts, TIMESTAMP '2026-01-01') / 86400000000::DOUBLE) AS d FROM events)""")
def temporal_freshness(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.select("event_id", T.temporal_freshness(F.col("ts"), F.lit("2026-01-01").cast("timestamp")).alias("value"))


REFINED = r""",
r1 AS (SELECT fact_id, text, regexp_replace(regexp_replace(regexp_replace(text, '^[^\p{L}\p{N}_\x{0980}-\x{09FF}]+', ''), '[^\p{L}\p{N}_\x{0980}-\x{09FF}.।!]+$', ''), '\s{2,}', ' ', 'g') AS x FROM facts),
r2 AS (SELECT fact_id, text, list_filter(list_transform(regexp_split_to_array(x, '[.।]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM r1),
r3 AS (SELECT fact_id, text, p, list_transform(p, lambda s: lower(s)) AS low FROM r2),
r4 AS (SELECT fact_id, text, array_to_string(list_filter(p, lambda s, i: list_position(low, lower(s)) = i), '. ') AS j FROM r3),
r5 AS (SELECT fact_id, text, CASE WHEN j <> '' AND NOT regexp_matches(j, '[.।]$') THEN j || '.' ELSE j END AS j FROM r4),
refined AS (SELECT fact_id, text, CASE WHEN regexp_matches(j, '^\p{Ll}') THEN upper(j[1:1]) || j[2:] ELSE j END AS value FROM r5)
"""


@query("refine_text", D.sql(REFINED + "SELECT fact_id, value, CASE WHEN value <> text THEN 'REFINED' ELSE 'UNCHANGED' END AS status FROM refined", "parts"))
def refine_text(spark, sf_dir):
    rows = D.facts(spark, sf_dir).select("fact_id", "text", T.refine_text(F.col("text")).alias("value"))
    return rows.select("fact_id", "value", F.when(F.col("value") != F.col("text"), "REFINED").otherwise("UNCHANGED").alias("status"))


# tokens, ids
over_facts("tokenize_word", lambda t: F.array_join(T.tokens(t), " "), "array_to_string(regexp_extract_all(low, '[\\p{L}\\p{N}_]+'), ' ')")
over_facts("tokenize_space", lambda t: F.array_join(F.array_sort(T.space_tokens(t)), " "), "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(low, '[\\s\\p{P}\\p{S}]+'), lambda x: x <> ''))), ' ')")
over_facts("tokenize_mixed", lambda t: F.array_join(F.array_sort(T.mixed_tokens(t)), " "), "array_to_string(list_sort(list_distinct(regexp_extract_all(low, '[\\x{0980}-\\x{09FF}\\p{L}\\p{N}_]+'))), ' ')")
over_facts("fingerprint", T.fingerprint, "sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')))")


@query("name_to_id", "SELECT c_custkey, 'ENTITY_' || replace(trim(c_name), ' ', '_') AS entity_id, 'TOPIC_' || upper(replace(trim(c_mktsegment), ' ', '_')) AS topic_id FROM customer")
def name_to_id(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat(F.lit("ENTITY_"), T.name_to_id(F.col("c_name"))).alias("entity_id"), F.concat(F.lit("TOPIC_"), F.upper(T.name_to_id(F.col("c_mktsegment")))).alias("topic_id"))


@query("option_split", r"SELECT conv_id, turn, CASE WHEN contains(text, ') ') THEN text[1:strpos(text, ') ') - 1] ELSE text END AS key, CASE WHEN contains(text, ') ') THEN text[strpos(text, ') ') + 2:] ELSE text END AS body FROM conversations")
def option_split(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations")
    x = F.split("text", r"\) ", 2)
    return c.select("conv_id", "turn", x[0].alias("key"), F.coalesce(F.get(x, 1), F.col("text")).alias("body"))


# web
@query("sentence_split", D.sql("SELECT fact_id, text FROM facts", "parts"))
def sentence_split(spark, sf_dir):
    return D.facts(spark, sf_dir).select("fact_id", "text")


RECORD = r"CASE WHEN length(regexp_replace(text, '[^\x{0980}-\x{09FF}]', '', 'g')) > 0.3 * length(text) THEN 'bn' ELSE 'en' END"


@query("sentence_record", D.sql(rf"SELECT fact_id, {RECORD} AS lang, len(regexp_extract_all(text, '\S+')) AS word_count, md5(text)[1:12] AS hash FROM facts", "parts"))
def sentence_record(spark, sf_dir):
    bn = F.length(F.regexp_replace("text", "[^ঀ-৿]", "")) > 0.3 * F.length("text")
    return D.facts(spark, sf_dir).select("fact_id", F.when(bn, "bn").otherwise("en").alias("lang"), F.size(F.split(F.trim("text"), r"\s+")).cast("bigint").alias("word_count"), F.substring(F.md5("text"), 1, 12).alias("hash"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query("publisher_from_url", f"SELECT page_id, CASE WHEN h = '' THEN '' {' '.join(f'WHEN contains(h, {lit(k)}) THEN {lit(v)}' for k, v in L.PUBLISHERS)} ELSE upper(split_part(h, '.', 1)[1:1]) || lower(split_part(h, '.', 1)[2:]) END AS publisher FROM (SELECT page_id, {HOST} AS h FROM pages)")
def publisher_from_url(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.publisher(F.col("url")).alias("publisher"))


@query("blocked_domain", f"SELECT page_id, {parts(L.BLOCKED_DOMAINS, HOST)} AS blocked FROM pages")
def blocked_domain(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.blocked(F.col("url")).alias("blocked"))


@query("as_fact_rows", D.sql(f"SELECT fact_id, text AS fact_text, {RECORD} AS lang, source_url, publisher FROM facts", "parts"))
def as_fact_rows(spark, sf_dir):
    bn = F.length(F.regexp_replace("text", "[^ঀ-৿]", "")) > 0.3 * F.length("text")
    return D.facts(spark, sf_dir).select("fact_id", F.col("text").alias("fact_text"), F.when(bn, "bn").otherwise("en").alias("lang"), "source_url", "publisher")


ARTICLE = r"regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g')"


@query("scan_html", rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace({ARTICLE}, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def scan_html(spark, sf_dir):
    return html.page_text(D.spread(D.table(spark, sf_dir, "pages"))).select("page_id", "text")


@query("scan_urls")
def scan_urls(spark, sf_dir):
    """Sentences of all pages that are not blocked, each once, at its first page and position."""
    return html.page_sentences(D.table(spark, sf_dir, "pages"))
