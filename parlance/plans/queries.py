"""The engine's operators over the driver's tables, each over whole tables and texts, with SQL for DuckDB beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions import constants as C
from parlance.functions import text as T
from parlance.operators import cluster, grounding, metrics, naming, refine, segmentation
from parlance.plans import models
from parlance.sinks import export
from parlance.sources.tables import conversation_segments, conversation_words, event_spans, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the same text functions in SQL ---


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def s_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def s_tokens(x: str) -> str:
    return f"list_filter(string_split(coalesce({s_norm(x)}, ''), ' '), lambda t: t <> '')"


def s_content(x: str) -> str:
    return f"list_filter({s_tokens(x)}, lambda t: t NOT IN {_in(C.STOPWORDS)} AND length(t) > 2)"


def s_white(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '\s+'), lambda t: t <> '')"


def s_stem(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{a}') AND length({t}) - {len(a)} >= 3 THEN left({t}, length({t}) - {len(a)}) || '{b}'" for a, b in C.SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def s_stems(x: str) -> str:
    return f"list_distinct(list_transform({s_content(x)}, lambda t: {s_stem('t')}))"


def s_sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: t <> '')"


# --- text ---


@query(f"SELECT doc_id, len(t) AS n_tokens, len(c) AS n_content, len(list_distinct(c)) AS n_distinct FROM (SELECT doc_id, {s_tokens('text')} AS t, {s_content('text')} AS c FROM documents)")
def tok_content_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.content(F.col("text")).alias("c"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("c").cast("long").alias("n_content"), F.size(F.array_distinct("c")).cast("long").alias("n_distinct"))


@query(f"SELECT stem, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM (SELECT conv_id, unnest({s_stems('text')}) AS stem FROM conversations) GROUP BY stem")
def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.stems(F.col("text"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("n_convs"))


@query(rf"SELECT doc_id, array_to_string(list_filter({s_tokens('text')}, lambda t: regexp_matches(t, '^\d+(st|nd|rd|th)?$') OR t IN {_in(C.NUMBER_WORDS)}), ' ') AS numbers, array_to_string(list_sort(regexp_extract_all(text, '\d+')), ' ') AS digit_runs FROM documents")
def numeric_content_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.array_join(T.numeric_content(F.col("text")), " ").alias("numbers"), F.array_join(T.digit_runs(F.col("text")), " ").alias("digit_runs"))


_NEG = rf"array_to_string(list_sort(list_distinct(list_filter({s_tokens(chr(123) + 'x' + chr(125))}, lambda t: t IN {_in(C.NEGATIONS)}))), ' ')"


def s_negations(x: str) -> str:
    return _NEG.replace("{x}", f"regexp_replace({x}, '[''’]', '', 'g')")


@query(f"SELECT doc_id, {s_negations('text')} AS negations FROM documents")
def negation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.negations(F.col("text")), " ").alias("negations"))


@query(rf"SELECT conv_id, turn, len({s_sentences('text')}) AS n_sentences, {s_sentences('text')}[1] AS first_sentence FROM conversations")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("s", T.sentences(F.col("text")))
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


@query(rf"""
WITH s AS (SELECT conv_id, turn, unnest({s_sentences('text')}) AS s FROM conversations),
n AS (SELECT conv_id, turn, regexp_extract(s, '^([A-Z][a-z]+),\s+\S', 1) AS a, regexp_extract(s, ',\s+([A-Z][a-z]+)\s*[?.!]$', 1) AS b FROM s),
v AS (SELECT conv_id, turn, CASE WHEN a <> '' AND lower(a) NOT IN {_in(C.DISCOURSE + C.COMMON_WORDS)} THEN a
  WHEN b <> '' AND lower(b) NOT IN {_in(C.DISCOURSE + C.COMMON_WORDS)} THEN b END AS name FROM n)
SELECT conv_id, turn, name, count(*) AS n FROM v WHERE name IS NOT NULL GROUP BY ALL""")
def vocatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    rows = naming._vocative(rows, "sentence", None)
    return rows.groupBy("conv_id", "turn", "name").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT doc_id, CAST(floor(len({s_white('text')}) * 1.33) AS INT) + 1200 AS tokens, CASE WHEN CAST(floor(len({s_white('text')}) * 1.33) AS INT) + 1200 <= 4500 THEN 'remote' ELSE 'local' END AS backend FROM documents")
def backend_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.route(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), "text"))
    return rows.select(F.col("meeting_id").alias("doc_id"), "tokens", "backend")


@query(f"""
WITH p AS (SELECT a.conv_id, a.turn, {s_tokens('a.text')} AS have, list_transform(list_filter({s_tokens('b.text')}, lambda t: length(t) > 3), lambda t: {s_stem('t')}) AS want
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(want) = 0 THEN false ELSE len(list_filter(want, lambda w: list_contains(list_transform(have, lambda t: {s_stem('t')}), w))) / len(want) >= 0.2 END AS holds FROM p""")
def idea_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("phrase"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.contains_idea(F.col("text"), F.col("phrase"), 0.2).alias("holds"))


@query("SELECT event_id, CAST(CAST(trunc(value) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(trunc(value) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM events")
def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.clock(F.col("value")).alias("clock"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def reply_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies, fenced and wrapped in prose, read back: the fence and the prose are put around each event's JSON."""
    rows = table(spark, sf_dir, "events")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" - done")))
    return rows.select("event_id", T.json_object(wrapped, "k string")["k"].alias("k"))


# --- gates ---


def _persisted(rows: DataFrame, name: str) -> DataFrame:
    """Rows that several steps read, kept by executors (memory, then disk) and computed again where one is lost."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("replacement"))
    return b.join(after, "item_id").withColumnRenamed("text", "original")


_LONGER = "'the replacement is over twice as long as the original'"
_SHORTER = "'the original is over twice as long as the replacement'"
_SPAN = f"CASE WHEN len({s_white('a.text')}) > 5 THEN 'the original has ' || len({s_white('a.text')}) || ' words, over 5' WHEN a.text <> '' AND length(b.text) > 2.0 * length(a.text) THEN {_LONGER} WHEN b.text <> '' AND length(a.text) > 2.0 * length(b.text) THEN {_SHORTER} END"
_PAIRS = "FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


@query(f"SELECT a.item_id, {_SPAN} AS reason {_PAIRS}")
def gate_length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = refine.text_gates(F.col("original"), F.col("replacement"), F.col("original"), F.lit(0))
    return _neighbours(spark, sf_dir).select("item_id", gates["span"].alias("reason"))


@query(rf"""
WITH e AS (SELECT a.item_id, list_filter([
  CASE WHEN {s_norm('a.text')} = {s_norm('b.text')} THEN 'original and replacement differ in case or marks only' END,
  {_SPAN},
  CASE WHEN list_sort(regexp_extract_all(a.text, '\d+')) <> list_sort(regexp_extract_all(b.text, '\d+')) THEN 'the numbers differ' END,
  CASE WHEN {s_negations('a.text')} <> {s_negations('b.text')} THEN 'the negations differ' END], lambda r: r IS NOT NULL) AS r {_PAIRS})
SELECT item_id, array_to_string(r, ' | ') AS reasons, len(r) AS n FROM e""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = refine.text_gates(F.col("original"), F.col("replacement"), F.col("original"), F.lit(0))
    reasons = F.array_compact(F.array(*(g[n] for n in ("anchor", "noop", "type", "span", "digits", "negation"))))
    return _neighbours(spark, sf_dir).select("item_id", F.array_join(reasons, " | ").alias("reasons"), F.size(reasons).cast("long").alias("n"))


@query(f"""
WITH d AS (SELECT source, doc_id, n_chars % 3 <> 0 AS ok, len({s_white('text')}) AS words FROM documents),
b AS (SELECT source, greatest(5, sum(words) // 20) AS budget FROM d GROUP BY source),
r AS (SELECT d.*, CASE WHEN ok THEN count(*) FILTER (ok) OVER (PARTITION BY source ORDER BY doc_id) END AS k FROM d)
SELECT r.source, doc_id, ok AND k <= budget AS accepted FROM r JOIN b ON r.source = b.source""")
def edit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    edits = d.select(F.col("source").alias("meeting_id"), F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 3 != 0).alias("accepted"), F.array().cast("array<string>").alias("rejections"))
    counts = d.groupBy(F.col("source").alias("meeting_id")).agg(F.sum(F.size(T.white_tokens(F.col("text")))).alias("total_words"))
    return refine.apply_budget(edits, counts).select(F.col("meeting_id").alias("source"), F.col("ordinal").alias("doc_id"), "accepted")


@query()
def glossary_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic correction path over whole conversations: phonetic codes, so no SQL."""
    c = table(spark, sf_dir, "conversations")
    terms = refine.glossary_of(spark)
    segments, words = conversation_segments(c), conversation_words(c)
    _, edits = refine.refine(segments, words, terms, keep=_persisted)
    return edits.select(F.col("meeting_id").alias("conv_id"), F.col("segment_id").alias("turn"), "original", "replacement", "accepted", F.array_join("rejections", " | ").alias("rejections"))


# --- segmentation and windows ---


@query(rf"""
WITH w AS (SELECT conv_id, turn, {s_white('text')} AS ws FROM conversations),
n AS (SELECT conv_id, turn, ws, unnest(range(1, 6)) AS n FROM w),
i AS (SELECT conv_id, turn, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM n WHERE n <= len(ws)),
p AS (SELECT conv_id, turn, n, i, ws[i + 1 : i + n] AS p FROM i)
SELECT conv_id, turn, n, count(*) AS n_phrases, min(array_to_string(p, ' ')) AS first_phrase
FROM p WHERE len(list_filter(p[1 : n - 1], lambda w: regexp_matches(w, '[.?!]$'))) = 0 AND len(list_filter(p, lambda w: length(w) % 3 = 0)) > 0 GROUP BY ALL""")
def ngram_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.low_confidence_ngrams(conversation_words(table(spark, sf_dir, "conversations")))
    rows = rows.groupBy("meeting_id", "segment_id", "n").agg(F.count(F.lit(1)).alias("n_phrases"), F.min("phrase").alias("first_phrase"))
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), F.col("n").cast("long").alias("n"), "n_phrases", "first_phrase")


_SPANS = "s AS (SELECT *, epoch_us(ts) / 3.6e9 AS start, epoch_us(ts) / 3.6e9 + {h} AS fin, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
_CHUNKS = f"""WITH {_SPANS.format(h='1.0')},
f AS (SELECT *, CASE WHEN start - lag(fin) OVER w > 24.0 OR lag(fin) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM f),
c AS (SELECT user_id, CAST(run AS BIGINT) - 1 AS chunk_idx, count(*) AS n_words, min(start) AS start, arg_max(fin, idx) AS fin FROM r GROUP BY user_id, run)"""


def _event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_spans(table(spark, sf_dir, "events"))
    words = e.select(F.col("user_id").alias("meeting_id"), F.lit(0).alias("segment_id"), F.col("idx").alias("word_idx"), F.col("event_type").alias("word"), "start", "end")
    segments = words.select("meeting_id", "segment_id").distinct().selectExpr("meeting_id", "segment_id", "cast(0 as double) start", "cast(0 as double) end", "'' as text")
    return segmentation.pause_chunks(words, segments, gap=24.0)


@query(_CHUNKS + " SELECT user_id, chunk_idx, n_words, round(start, 6) AS start, round(fin, 6) AS fin FROM c")
def pause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_chunks(spark, sf_dir)
    return rows.select(F.col("meeting_id").alias("user_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.size("word_refs").cast("long").alias("n_words"), F.round("start", 6).alias("start"), F.round("end", 6).alias("fin"))


@query(_CHUNKS + " SELECT user_id, CASE WHEN fin - start >= 0.60 THEN 'long' WHEN fin - start >= 0.25 THEN 'short' ELSE 'tiny' END AS kind, count(*) AS n FROM c GROUP BY ALL")
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_chunks(spark, sf_dir).groupBy(F.col("meeting_id").alias("user_id"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SPANS.format(h='1.0')},
f AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND idx > 0 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM f)
SELECT user_id, CAST(run AS BIGINT) - 1 AS turn_idx, any_value(event_type) AS event_type, count(*) AS n_parts, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY idx) AS text FROM r GROUP BY user_id, run""")
def merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_spans(table(spark, sf_dir, "events")).withColumn("text", F.col("event_id").cast("string"))
    rows = segmentation.merge_turns(e, ["user_id"], "event_type", ["idx"])
    return rows.select("user_id", F.col("turn_idx").cast("long").alias("turn_idx"), "event_type", "n_parts", "text")


@query(f"""WITH {_SPANS.format(h='1.0')}, f AS (SELECT user_id, event_type, min(idx) AS first_idx FROM s GROUP BY ALL)
SELECT user_id, event_type, 'Speaker ' || row_number() OVER (PARTITION BY user_id ORDER BY first_idx) AS speaker FROM f""")
def first_appearance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.first_appearance(event_spans(table(spark, sf_dir, "events")), ["user_id"], "event_type", "idx")
    return rows.select("user_id", "event_type", "speaker").distinct()


@query(f"""WITH {_SPANS.format(h='1.0')}, n AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN event_type END AS label FROM s)
SELECT user_id, event_id, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'none') AS label FROM n""")
def label_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_spans(table(spark, sf_dir, "events")).withColumn("label", F.when(F.col("event_id") % 3 == 0, F.col("event_type")))
    return segmentation.fill_labels(e, ["user_id"], "label", ["idx"], "none").select("user_id", "event_id", "label")


@query("SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("role").over(w).alias("next_role"), F.lead(F.char_length("text")).over(w).cast("long").alias("next_chars"))


@query("SELECT a.conv_id, a.turn, min(b.turn) AS reply_turn, arg_min(b.role, b.turn) AS reply_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.role IS DISTINCT FROM a.role GROUP BY ALL")
def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.first_other_reply(conversation_segments(table(spark, sf_dir, "conversations")))
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("utt_idx").cast("long").alias("turn"), F.col("reply_idx").cast("long").alias("reply_turn"), F.col("reply_speaker").alias("reply_role"))


@query(r"SELECT conv_id, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY turn) AS text, count(*) AS n_segments FROM conversations GROUP BY conv_id")
def transcript_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.assemble(conversation_segments(table(spark, sf_dir, "conversations")))
    return rows.select(F.col("meeting_id").alias("conv_id"), "text", "n_segments")


@query("SELECT '[' || CAST(turn * 10 AS VARCHAR) || 's] (segment ' || CAST(turn AS VARCHAR) || ') ' || role || ': ' || text AS line, conv_id, turn FROM conversations")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.render_segments(conversation_segments(table(spark, sf_dir, "conversations")))
    return rows.select("line", F.col("meeting_id").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"))


@query(f"""WITH t AS (SELECT conv_id, turn, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a,
  string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b FROM conversations)
SELECT conv_id, turn, len({s_tokens('a')}) AS n_near, len({s_tokens('b')}) AS n_context FROM t""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation_segments(table(spark, sf_dir, "conversations"))
    rows = segmentation.context_windows(segmentation.context_windows(s, C.NAME_SEGMENTS, name="a"), C.CONTEXT_SEGMENTS, name="b")
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), F.size(T.tokens(F.col("a"))).cast("long").alias("n_near"), F.size(T.tokens(F.col("b"))).cast("long").alias("n_context"))


# --- grounding ---


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.withColumn("seg_idx", F.col("doc_id") * 1_000_000 + F.col("line"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"


@query(f"""WITH {_LINES},
q AS (SELECT item_id, {s_content('text')} AS want FROM benchmark),
qt AS (SELECT item_id, len(want) AS n, unnest(want) AS token FROM q WHERE len(want) >= 3),
lt AS (SELECT doc_id, line, unnest(list_distinct({s_content('text')})) AS token FROM l),
s AS (SELECT item_id, n, doc_id, line, count(*) AS hits FROM qt JOIN lt USING (token) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id, line) AS k FROM s WHERE hits / n >= 0.6)
SELECT q.item_id, round(b.hits / b.n, 6) AS score, b.doc_id, CAST(b.line AS BIGINT) AS line, CASE WHEN b.item_id IS NULL THEN 'dropped' ELSE 'supported' END AS status
FROM q LEFT JOIN b ON q.item_id = b.item_id AND b.k = 1""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which line of any document supports each benchmark text."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    rows = grounding.ground_quotes(quotes, _lines(spark, sf_dir).select("seg_idx", "text"), pairs=False, keys=())
    return rows.select(F.col("quote_id").alias("item_id"), F.round("score", 6).alias("score"), F.floor(F.col("seg_idx") / 1_000_000).alias("doc_id"), (F.col("seg_idx") % 1_000_000).alias("line"), "status")


@query(f"""WITH c AS (SELECT conv_id, turn, text, {s_content('text')} AS have, list_slice({s_content('text')}, len({s_content('text')}) // 2 + 1, len({s_content('text')})) || list_slice({s_content("coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")}, 1, 4) AS want FROM conversations),
w AS (SELECT a.conv_id, a.turn AS quote_id, a.want, b.turn AS spot, 0 AS pair, b.have AS here, CAST([] AS VARCHAR[]) AS nxt FROM c a JOIN c b ON a.conv_id = b.conv_id
  UNION ALL SELECT a.conv_id, a.turn, a.want, b.turn, 1, b.have, d.have FROM c a JOIN c b ON a.conv_id = b.conv_id JOIN c d ON d.conv_id = b.conv_id AND d.turn = b.turn + 1),
s AS (SELECT conv_id, quote_id, spot, pair, len(want) AS n, len(list_filter(want, lambda t: list_contains(here, t) OR list_contains(nxt, t))) AS hits,
  len(list_filter(want, lambda t: list_contains(here, t))) AS a, len(list_filter(want, lambda t: list_contains(nxt, t))) AS b FROM w WHERE len(want) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, quote_id ORDER BY hits DESC, spot, pair) AS k FROM s WHERE hits / n >= 0.6)
SELECT c.conv_id, c.turn AS quote_id, round(r.hits / r.n, 6) AS score, CASE WHEN r.pair = 0 OR r.a >= r.b THEN r.spot ELSE r.spot + 1 END AS turn
FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.quote_id AND r.k = 1""")
def quote_grounding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that run from the second half of a turn into the next one, within their conversation."""
    s = conversation_segments(table(spark, sf_dir, "conversations"))
    own = T.content(F.col("text"))
    after = T.content(F.coalesce(F.lead("text").over(Window.partitionBy("meeting_id").orderBy("seg_idx")), F.lit("")))
    half = F.slice(own, F.floor(F.size(own) / 2).cast("int") + 1, F.greatest(F.size(own), F.lit(1)))
    quotes = s.select("meeting_id", F.col("seg_idx").alias("quote_id"), F.array_join(F.concat(half, F.slice(after, 1, 4)), " ").alias("quote"))
    rows = grounding.ground_quotes(quotes, s.select("meeting_id", "seg_idx", "text"))
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("quote_id").cast("long").alias("quote_id"), F.round("score", 6).alias("score"), F.col("seg_idx").cast("long").alias("turn"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, list_slice({s_tokens('text')}, 1, 2) AS quote, {s_stems('text')} AS want FROM conversations),
ok AS (SELECT * FROM c WHERE len(quote) > 0 AND len(want) > 0 AND len({s_content("array_to_string(quote, ' ')")}) < 3),
x AS (SELECT conv_id, turn, text, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS context FROM conversations),
h AS (SELECT ok.conv_id, ok.turn AS claim, x.turn AS spot, len(list_filter(ok.want, lambda w: list_contains({s_stems('x.context')}, w))) / len(ok.want) AS support
  FROM ok JOIN x ON ok.conv_id = x.conv_id AND contains(' ' || array_to_string({s_tokens('x.text')}, ' ') || ' ', ' ' || array_to_string(ok.quote, ' ') || ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, claim ORDER BY support DESC, spot) AS k FROM h WHERE support >= 0.5)
SELECT conv_id, claim, spot AS turn, round(support, 6) AS support FROM b WHERE k = 1""")
def short_quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation_segments(table(spark, sf_dir, "conversations"))
    claims = s.select("meeting_id", F.col("seg_idx").alias("claim_id"), F.col("text").alias("claim"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 2), " ").alias("evidence"))
    rows = grounding.find_short_quotes(claims, s)
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("claim_id").cast("long").alias("claim"), F.col("seg_idx").cast("long").alias("turn"), F.round("support", 6).alias("support"))


@query()
def merge_duplicate_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold: no SQL. Turns as tasks, roles as owners."""
    s = conversation_segments(table(spark, sf_dir, "conversations"))
    rows = grounding.merge_tasks(s.select("meeting_id", F.col("seg_idx").alias("claim_id"), F.col("text").alias("task"), F.col("speaker").alias("owner"), F.lit(None).cast("string").alias("deadline")))
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("claim_id").alias("turn"), "merged_into")


# --- glossary joins ---

_TERMS = C.NEGATIONS + C.NUMBER_WORDS


def _doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def _term_list(spark: SparkSession) -> DataFrame:
    return refine.glossary_of(spark, _TERMS).select(F.col("norm").alias("token"))


_TOKENS = f"t AS (SELECT doc_id, unnest({s_tokens('text')}) AS token FROM documents)"


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS n FROM t WHERE token IN {_in(_TERMS)} GROUP BY doc_id")
def glossary_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_tokens(spark, sf_dir).join(_term_list(spark), "token", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOKENS} SELECT doc_id, count(*) AS n FROM t WHERE token NOT IN {_in(_TERMS)} GROUP BY doc_id")
def glossary_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_tokens(spark, sf_dir).join(_term_list(spark), "token", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_FOLD = "list_transform(list_transform({t}, lambda x: CASE WHEN x = {t}[1] THEN 'alpha' ELSE x END), lambda x: CASE WHEN x = list_transform({t}, lambda y: CASE WHEN y = {t}[1] THEN 'alpha' ELSE y END)[-1] THEN 'omega' ELSE x END)"


@query(f"WITH c AS (SELECT conv_id, turn, {s_tokens('text')} AS t FROM conversations) SELECT conv_id, turn, array_to_string({_FOLD.format(t='t')}, ' ') AS text FROM c")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of every turn, one on the result of the other: its first word, then what is its last word by then."""
    s = conversation_segments(table(spark, sf_dir, "conversations")).withColumn("t", T.tokens(F.col("text"))).withColumn("text", F.array_join("t", " "))
    some = s.where(F.size("t") > 0)
    first, last = F.col("t")[0], F.element_at("t", -1)
    edit = lambda n, o, r: some.select("meeting_id", "segment_id", F.lit(n).alias("ordinal"), o.alias("original"), F.lit(r).alias("replacement"), F.lit(True).alias("accepted"))
    edits = edit(0, first, "alpha").union(edit(1, F.when(last == first, "alpha").otherwise(last), "omega"))
    rows = refine.apply_edits(s, edits)
    return rows.select(F.col("meeting_id").alias("conv_id"), F.col("segment_id").cast("long").alias("turn"), "text")


# --- intervals and metrics ---


@query(f"""WITH {_SPANS.format(h='6.0')}
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, round(least(a.fin, b.fin) - greatest(a.start, b.start), 6) AS seconds
FROM s a JOIN s b ON a.user_id = b.user_id AND a.start < b.fin AND b.start < a.fin AND a.event_type = 'purchase' AND b.event_type <> 'purchase'""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_spans(table(spark, sf_dir, "events"), hours=6.0).withColumnRenamed("event_id", "id")
    rows = metrics.interval_overlap(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), ["user_id"], bucket=24.0)
    return rows.select("user_id", "a_id", "b_id", F.round("seconds", 6).alias("seconds"))


@query(f"""WITH {_SPANS.format(h='6.0')},
o AS (SELECT a.user_id, a.event_id AS a_id, b.event_type AS who, round(sum(least(a.fin, b.fin) - greatest(a.start, b.start)), 6) AS sec
FROM s a JOIN s b ON a.user_id = b.user_id AND a.start < b.fin AND b.start < a.fin GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a_id ORDER BY sec DESC, who DESC) AS k, sum(sec) OVER (PARTITION BY user_id, a_id) AS total FROM o)
SELECT user_id, a_id, who AS speaker, round(sec / total, 6) AS share, sec / total >= 0.9 AS is_pure FROM r WHERE k = 1""")
def chunk_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_spans(table(spark, sf_dir, "events"), hours=6.0).withColumnRenamed("event_id", "id")
    o = metrics.interval_overlap(e, e, ["user_id"], bucket=24.0).join(e.select("user_id", F.col("id").alias("b_id"), F.col("event_type").alias("b_speaker")), ["user_id", "b_id"])
    o = o.groupBy("user_id", "a_id", "b_speaker").agg(F.round(F.sum("seconds"), 6).alias("seconds"))
    return metrics.chunk_purity(o, ["user_id"]).select("user_id", "a_id", "speaker", F.round("share", 6).alias("share"), "is_pure")


_LABELS = """a AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY idx) AS fin, event_type AS label FROM s),
aa AS (SELECT * FROM a WHERE fin > start), bb AS (SELECT user_id, start + 2.0 AS start, fin + 2.0 AS fin, label FROM aa)"""


@query(f"""WITH {_SPANS.format(h='1.0')}, {_LABELS},
o AS (SELECT aa.user_id, CASE WHEN aa.label = bb.label THEN 'agree' ELSE 'confusion' END AS kind, least(aa.fin, bb.fin) - greatest(aa.start, bb.start) AS sec FROM aa JOIN bb ON aa.user_id = bb.user_id AND aa.start < bb.fin AND bb.start < aa.fin),
t AS (SELECT user_id, kind, sum(sec) AS sec FROM o GROUP BY ALL
  UNION ALL SELECT user_id, 'missed', sum(fin - start) - coalesce((SELECT sum(sec) FROM o WHERE o.user_id = aa.user_id), 0) FROM aa GROUP BY user_id
  UNION ALL SELECT user_id, 'false_alarm', sum(fin - start) - coalesce((SELECT sum(sec) FROM o WHERE o.user_id = bb.user_id), 0) FROM bb GROUP BY user_id)
SELECT user_id, kind, round(sec, 4) AS seconds FROM t WHERE round(sec, 4) > 0""")
def frame_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labellings of time: each event's type until the next event, and the same two hours later."""
    e = event_spans(table(spark, sf_dir, "events"))
    w = Window.partitionBy("user_id").orderBy("idx")
    a = e.select("user_id", "start", F.lead("start").over(w).alias("end"), F.col("event_type").alias("label")).where("end > start")
    b = a.select("user_id", (F.col("start") + 2.0).alias("start"), (F.col("end") + 2.0).alias("end"), "label")
    rows = metrics.frame_sweep(a, b, ["user_id"])
    return rows.select("user_id", "kind", F.round("seconds", 4).alias("seconds")).where("seconds > 0")


_CELL = """CASE WHEN k + 1 - i < 0 OR k + 1 - i > len(h) THEN NULL WHEN i = 0 THEN (k + 1) * 1000000000000 WHEN k + 1 - i = 0 THEN i * 1000000000001
  WHEN r[i] = h[k + 1 - i] THEN two[i] WHEN two[i] // 1000000000000 <= least(one[i], one[i + 1]) // 1000000000000 THEN two[i] + 1000001000000
  WHEN one[i] // 1000000000000 <= one[i + 1] // 1000000000000 THEN one[i] + 1000000000001 ELSE one[i + 1] + 1000000000000 END"""


@query(f"""WITH RECURSIVE p AS (SELECT a.item_id, {s_tokens('a.text')} AS r, {s_tokens('b.text')} AS h {_PAIRS}),
g AS (SELECT item_id, r, h, CAST(0 AS BIGINT) AS k, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN i = 0 THEN CAST(0 AS BIGINT) END) AS one, list_transform(range(0, len(r) + 1), lambda i: CAST(NULL AS BIGINT)) AS two FROM p
  UNION ALL SELECT item_id, r, h, k + 1, list_transform(range(0, len(r) + 1), lambda i: CAST({_CELL} AS BIGINT)), one FROM g WHERE k < len(r) + len(h)),
e AS (SELECT item_id, len(r) AS m, one[len(r) + 1] AS v FROM g WHERE k = len(r) + len(h))
SELECT item_id, CASE WHEN m > 0 THEN (v // 1000000000000) / m ELSE 0.0 END AS wer, CAST(v // 1000000 % 1000000 AS INTEGER) AS substitutions, CAST(v % 1000000 AS INTEGER) AS deletions,
  CAST(v // 1000000000000 - v // 1000000 % 1000000 - v % 1000000 AS INTEGER) AS insertions, CAST(m AS INTEGER) AS reference_words FROM e""")
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of each benchmark text with the next one. The SQL fills the table by its diagonals, a cell being the cost, the
    substitutions and the deletions in one number."""
    return metrics.wer(_neighbours(spark, sf_dir), "original", "replacement").drop("original", "replacement")


_FRAMES = f"""{_SPANS.format(h='4.0')}, z AS (SELECT user_id, min(start) AS t0 FROM s GROUP BY user_id),
t AS (SELECT s.user_id, idx, event_type AS who, CAST(floor(start - t0) AS BIGINT) AS f, CAST(ceil(fin - t0) AS BIGINT) AS l, CAST(floor(start - t0 + 2.0) AS BIGINT) AS f2, CAST(ceil(fin - t0 + 2.0) AS BIGINT) AS l2 FROM s JOIN z ON s.user_id = z.user_id),
a AS (SELECT user_id, frame, arg_max(who, idx) AS r FROM (SELECT user_id, idx, who, unnest(range(f, l)) AS frame FROM t) GROUP BY ALL),
b AS (SELECT user_id, frame, arg_max(who, idx) AS h FROM (SELECT user_id, idx, who, unnest(range(f2, l2)) AS frame FROM t) GROUP BY ALL),
k AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, r, h, CAST(count(*) AS BIGINT) AS n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.frame = b.frame GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_FRAMES}, e AS (SELECT list_sort(list(DISTINCT event_type)) AS every FROM events),
p AS (SELECT CAST([] AS VARCHAR[]) AS perm, every FROM e UNION ALL SELECT list_append(perm, x), every FROM (SELECT perm, every, unnest(list_filter(every, lambda v: NOT list_contains(perm, v))) AS x FROM p)),
f AS (SELECT perm, unnest(perm) AS h, unnest(every) AS r FROM p WHERE len(perm) = len(every)),
o AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, perm, sum(n) AS n FROM k JOIN f ON k.r = f.r AND k.h = f.h GROUP BY ALL) GROUP BY user_id),
c AS (SELECT user_id, coalesce(sum(n) FILTER (h IS NULL), 0) AS miss, coalesce(sum(n) FILTER (r IS NULL), 0) AS fals, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS total, coalesce(sum(n) FILTER (r IS NOT NULL AND h IS NOT NULL), 0) AS met FROM k GROUP BY user_id),
w AS (SELECT c.*, met - coalesce(o.n, 0) AS wrong FROM c LEFT JOIN o ON c.user_id = o.user_id)
SELECT user_id AS meeting_id, CASE WHEN total > 0 THEN CAST(miss + fals + wrong AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0.0 END AS der, CAST(miss AS DOUBLE) AS missed, CAST(fals AS DOUBLE) AS false_alarm, CAST(wrong AS DOUBLE) AS confusion, CAST(total AS DOUBLE) AS total FROM w""")
def diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of users' event types as voices against the same two hours later; frames of an hour. The SQL tries every
    one-to-one mapping of the types."""
    return metrics.der(*_shifted_turns(spark, sf_dir), collar=0.0, step=1.0)


def _shifted_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = event_spans(table(spark, sf_dir, "events"), hours=4.0)
    ref = e.select(F.col("user_id").alias("meeting_id"), F.col("idx").alias("ordinal"), "start", "end", F.col("event_type").alias("speaker"))
    first = ref.groupBy("meeting_id").agg(F.min("start").alias("t0"))
    ref = ref.join(first, "meeting_id").withColumn("start", F.col("start") - F.col("t0")).withColumn("end", F.col("end") - F.col("t0")).drop("t0")
    hyp = ref.withColumn("start", F.col("start") + 2.0).withColumn("end", F.col("end") + 2.0)
    return ref, hyp


@query("SELECT quality, count(*) FILTER (quality <> toxic) AS n_passed, count(*) AS n_checks FROM labels GROUP BY quality")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("passed", F.col("quality") != F.col("toxic"))
    return metrics.scorecard(rows, ["quality"])


@query("SELECT event_type AS backend, CAST(user_id % 5 AS VARCHAR) AS check_name, count(*) FILTER (value > 50) AS n_passed, count(DISTINCT user_id) AS n_runs, count(DISTINCT props) AS n_outputs FROM events GROUP BY ALL")
def trial_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("backend"), (F.col("user_id") % 5).cast("string").alias("check"), (F.col("value") > 50).alias("passed"), F.col("user_id").alias("run"), F.col("props").alias("output"))
    return metrics.trial_tally(rows).withColumnRenamed("check", "check_name")


# --- embeddings ---

_UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings)"
_CENT = f"{_UNIT}, p AS (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM u, unnest(range(1, len(v) + 1)) AS r(i) GROUP BY label, i), m AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS mean FROM p GROUP BY label), c AS (SELECT label, n, list_transform(mean, lambda x: x / greatest(sqrt(list_inner_product(mean, mean)), 1e-12)) AS v FROM m)"


@query(f"WITH {_UNIT}, d AS (SELECT a.label, a.vec_id, b.vec_id AS other, 1 - list_inner_product(a.v, b.v) AS d FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT label, vec_id, round(min(d), 6) AS nearest, count(*) AS n FROM d GROUP BY ALL")
def pairwise_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances within each label, as the nearest other vector of every vector."""
    rows = cluster.nearest_other(table(spark, sf_dir, "embeddings"), ["label"], "vec_id")
    return rows.select("label", "vec_id", F.round("nearest", 6).alias("nearest"), "n")


@query(f"WITH {_CENT} SELECT label, n, round(v[1], 6) AS first, round(v[len(v)], 6) AS last, round(list_sum(v), 6) AS total FROM c")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.centroids(table(spark, sf_dir, "embeddings"), ["label"])
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return rows.select("label", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"), F.round(total, 6).alias("total"))


@query(f"WITH {_CENT}, d AS (SELECT u.vec_id, c.label, 1 - list_inner_product(u.v, c.v) AS d, row_number() OVER (PARTITION BY u.vec_id ORDER BY 1 - list_inner_product(u.v, c.v), c.label) AS k FROM u, c) SELECT vec_id, label, round(d, 6) AS distance FROM d WHERE k = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = cluster.nearest_centroid(e.drop("label"), cluster.centroids(e, ["label"]), [], "vec_id", "label")
    return rows.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_CENT}, d AS (SELECT u.label, 1 - list_inner_product(u.v, c.v) AS d FROM u JOIN c ON u.label = c.label) SELECT label, count(*) AS n, round(avg(d), 6) AS mean_distance, round(quantile_cont(d, 0.9), 6) AS p90_distance FROM d GROUP BY label")
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread, _ = cluster.separability(table(spark, sf_dir, "embeddings"), [], "label")
    return spread.select("label", "n", F.round("mean_distance", 6).alias("mean_distance"), F.round("p90_distance", 6).alias("p90_distance"))


@query(f"WITH {_CENT} SELECT a.label AS a, b.label AS b, round(1 - list_inner_product(a.v, b.v), 6) AS distance FROM c a JOIN c b ON a.label < b.label")
def centroid_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, apart = cluster.separability(table(spark, sf_dir, "embeddings"), [], "label")
    return apart.select("a", "b", F.round("distance", 6).alias("distance"))


@query()
def cluster_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average linkage within each label: iterative, no SQL (tests hold it against brute force)."""
    return cluster.cluster(table(spark, sf_dir, "embeddings"), ["label"], "vec_id")


@query()
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.threshold_sweep(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", [k / 100 for k in range(30, 101, 5)])


# --- votes and records ---


@query("""WITH v AS (SELECT user_id // 10 AS meeting, user_id, event_type AS name, CAST(sum(event_id % 2 + 1) AS BIGINT) AS support, min(event_id) AS at FROM events GROUP BY ALL),
x AS (SELECT DISTINCT user_id, event_type AS name FROM events WHERE value < 0.5),
k AS (SELECT v.*, max(support) OVER (PARTITION BY user_id) AS top FROM v WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = v.user_id AND x.name = v.name)),
b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS ties FROM k WHERE support = top),
w AS (SELECT *, max(support) OVER (PARTITION BY meeting, name) AS best FROM b WHERE ties = 1),
f AS (SELECT *, count(*) OVER (PARTITION BY meeting, name) AS same FROM w WHERE support = best)
SELECT user_id, name, support FROM f WHERE same = 1""")
def vote_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as voices, event types as names, ten users a meeting: one name for a voice and one voice for a name."""
    e = table(spark, sf_dir, "events").withColumn("meeting_id", F.floor(F.col("user_id") / 10))
    votes = e.select("meeting_id", F.col("user_id").alias("speaker"), F.col("event_type").alias("name"), (F.col("event_id") % 2 + 1).alias("weight"), F.lit("").alias("evidence"), F.struct("event_id").alias("place"))
    own = e.where("value < 0.5").select("meeting_id", F.col("user_id").alias("speaker"), F.col("event_type").alias("name"))
    bindings, _, _ = naming.resolve_names(votes, own)
    return bindings.select(F.col("speaker").alias("user_id"), "name", F.col("support").cast("long").alias("support"))


@query("SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) AS first_text, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations exported as JSON and read back."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct("turn", "role", "text", F.lit(None).cast("string").alias("owner"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    rows = rows.select("conv_id", export.to_json("conv_id", "turns").alias("json"))
    back = F.from_json("json", "turns array<struct<turn:long,role:string,text:string,owner:string>>")["turns"]
    return rows.select("conv_id", F.size(back).cast("long").alias("n_turns"), back[0]["text"].alias("first_text"), F.element_at(back, -1)["role"].alias("last_role"))


@query("SELECT conv_id, string_agg('**' || role || '** [' || CAST((turn * 10) // 60 AS VARCHAR) || ':' || lpad(CAST((turn * 10) % 60 AS VARCHAR), 2, '0') || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def transcript_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation_segments(table(spark, sf_dir, "conversations")).withColumn("shown", F.col("speaker")).withColumn("turn_idx", F.col("seg_idx"))
    return export.turns_markdown(s).withColumnRenamed("meeting_id", "conv_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations)
SELECT conv_id, turn, CAST(greatest(0.0, turn * 10.0 - 2.0) AS DOUBLE) AS replay_from, position FROM r""")
def replay_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = conversation_segments(table(spark, sf_dir, "conversations"))
    rows = s.select("meeting_id", F.col("seg_idx").alias("ordinal"), F.col("text").alias("statement"), F.col("start").alias("timestamp"))
    none = rows.where(F.lit(False)).withColumnRenamed("statement", "task")
    out = export.timestamp_index(rows, none)
    return out.select(F.col("meeting_id").alias("conv_id"), F.col("ordinal").cast("long").alias("turn"), F.col("replay_from").cast("double").alias("replay_from"), F.col("position").cast("long").alias("position"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(ts) AS start FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming sessions."""
    from parlance.streaming.pauses import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", "n", "start")
