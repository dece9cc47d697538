"""Queries over conversations: dialogue assembly, keys and splits, labels, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators import dialogue as D
from dialoglake.operators import keys as K
from dialoglake.operators import labels as L
from dialoglake.plans import views as V
from dialoglake.plans.catalog import register

_NORM = "replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), ' ', '')"
_KEY = "lower(regexp_replace({0}, '\\s+', '', 'g'))"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_N, _K, _S = (x.replace("{0}", "text") for x in (_NORM, _KEY, _STRIP))

_PAIRS = f"""
t AS (SELECT conv_id, turn, role, {_N} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {_N} <> ''),
l AS (SELECT *, lag(role) OVER w AS br, lag(text) OVER w AS bt, lag(turn) OVER w AS bn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair_idx, bn AS user_turn, bt AS user_text, text AS assistant_text FROM l WHERE role = 'assistant' AND br = 'user')"""

_CONTEXT = f"""{_PAIRS},
context AS (
    SELECT a.conv_id, a.pair_idx, any_value(a.user_text) AS user_text,
        string_agg(CASE WHEN b.pair_idx = a.pair_idx THEN '[USER] ' || b.user_text ELSE '[USER] ' || b.user_text || chr(10) || '[ASSISTANT] ' || b.assistant_text END, chr(10) ORDER BY b.pair_idx) AS context,
        string_agg(b.user_text, chr(10) ORDER BY b.pair_idx) AS user_focus
    FROM pairs a JOIN pairs b ON a.conv_id = b.conv_id AND b.pair_idx BETWEEN a.pair_idx - 5 AND a.pair_idx GROUP BY a.conv_id, a.pair_idx)"""


def _first(text: str, lists: dict, otherwise: str) -> str:
    hits = " ".join("WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in terms) + f" THEN '{label}'" for label, terms in lists.items())
    return f"CASE {hits} ELSE '{otherwise}' END"


def _split(seed: str, key: str, test: int = 500, valid: int = 1000, modulus: int = 10_000) -> str:
    b = f"CAST('0x' || substr(md5('{seed}::' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {modulus}"
    return f"CASE WHEN {b} < {test} THEN 'test' WHEN {b} < {valid} THEN 'valid' ELSE 'train' END"


@register("corpus_samples", f"WITH {_CONTEXT} SELECT conv_id, pair_idx, {_split('7', 'conv_id')} AS split, context AS input, CAST(ceil(length(context) / 3.0) AS BIGINT) AS n_tokens, {_first('user_focus_n', V.RISK, 'R0')} AS risk, {_first('user_focus_n', V.EMOTION, 'none')} AS emotion, (contains(user_focus_n, 'the') OR contains(user_focus_n, 'and')) AS domain FROM (SELECT *, {_NORM.replace('{0}', 'user_focus')} AS user_focus_n FROM context)")
def corpus_samples(spark, sf):
    return L.corpus_samples(D.pair_context(D.pair_turns(V.turns(spark, sf))), "7", V.RISK, V.EMOTION, V.DOMAIN)


@register("pair_turns", f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_turns(spark, sf):
    return D.pair_turns(V.turns(spark, sf))


@register("pair_context", f"WITH {_CONTEXT} SELECT conv_id, pair_idx, context, user_focus FROM context")
def pair_context(spark, sf):
    return D.pair_context(D.pair_turns(V.turns(spark, sf))).select("conv_id", "pair_idx", "context", "user_focus")


_ADJ = "adj AS (SELECT * FROM (SELECT conv_id, turn, role, text AS user_text, lead(role) OVER w AS nr, lead(text) OVER w AS assistant_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


@register("adjacent_pairs", f"WITH {_ADJ} SELECT conv_id, turn, user_text, assistant_text FROM adj")
def adjacent_pairs(spark, sf):
    return D.adjacent_pairs(V.turns(spark, sf))


@register("canonical_messages", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND {_S} <> ''")
def canonical_messages(spark, sf):
    who = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    nested = V.turns(spark, sf).groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value")))).alias("x"))
    return D.canonical_turns(nested.select("id", F.transform("x", lambda m: F.struct(m["from"].alias("from"), m["value"].alias("value"))).alias("conversations")))


@register("to_sharegpt", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END || '=' || text, chr(10) ORDER BY turn) AS flat FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id HAVING last(role ORDER BY turn) = 'user'")
def to_sharegpt(spark, sf):
    flat = F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit("="), m["value"])), "\n")
    return D.to_sharegpt(V.turns(spark, sf)).select("conv_id", flat.alias("flat"))


@register("alternating", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations WHERE {_S} <> '')")
def alternating(spark, sf):
    lists = V.turns(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.col("x.text").alias("texts"))
    return D.read_alternating(lists)


@register("instruction_reference", f"""WITH {_ADJ.replace('FROM conversations', "FROM conversations WHERE role IN ('user', 'assistant')")}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM adj)
SELECT conv_id, string_agg('U: ' || user_text || CASE WHEN back > 1 THEN chr(10) || 'A: ' || assistant_text ELSE '' END, chr(10) ORDER BY turn) || chr(10) || 'A: ' AS instruction, max(CASE WHEN back = 1 THEN assistant_text END) AS reference FROM b WHERE back <= 3 GROUP BY conv_id""")
def instruction_reference(spark, sf):
    return D.instruction_reference(V.turns(spark, sf), 3, "U: ", "A: ")


_END = f"""ends AS (SELECT conv_id, max_by(turn, r * 1000 + turn) AS end_turn FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'the') AND NOT low THEN 2 WHEN NOT low THEN 1 ELSE 0 END AS r
FROM (SELECT *, length({_K}) < 40 OR {_K} IN ('ok') OR (contains({_K}, 'und') AND NOT regexp_matches(text, 'the')) AS low FROM conversations WHERE role = 'user')) GROUP BY conv_id)"""
_LISTS = {"request": "the", "acks": ["ok"], "closings": ["und"]}


@register("pick_end_user", f"WITH {_END} SELECT * FROM ends")
def pick_end_user(spark, sf):
    return D.pick_end_user(V.turns(spark, sf), 40, **_LISTS)


_TAIL = f"""{_END}, up AS (SELECT c.*, coalesce(sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS users
FROM conversations c JOIN ends USING (conv_id) WHERE turn <= end_turn), tail AS (SELECT conv_id, turn, role, text FROM up WHERE users < 2)"""


@register("tail_turns", f"WITH {_TAIL} SELECT * FROM tail")
def tail_turns(spark, sf):
    t = V.turns(spark, sf)
    return D.tail_turns(t, D.pick_end_user(t, 40, **_LISTS), 2)


@register("prompt_pool", f"WITH {_TAIL} SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM tail GROUP BY conv_id")
def prompt_pool(spark, sf):
    return D.prompt_pool(V.turns(spark, sf), 2, 40, **_LISTS)


_UW = " UNION ALL ".join(f"SELECT conv_id, {k} AS n_turns, turn AS start, string_agg(t, chr(10)) OVER w AS text, count(*) OVER w AS n, bool_and(ok) OVER w AS ok FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)" for k in (1, 2, 3))


@register("user_windows", f"""WITH u AS (SELECT conv_id, turn, {_N} AS t, length({_N}) BETWEEN 4 AND 400 AND NOT contains({_N}, 'disgusting') AS ok FROM conversations WHERE role = 'user'),
w AS (SELECT * FROM ({_UW}) WHERE n = n_turns AND ok AND length(text) >= 8), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n_turns ORDER BY md5('42|' || conv_id || '|' || n_turns || '|' || start), start) AS r FROM w)
SELECT conv_id, n_turns, start, text, length(text) AS chars FROM r WHERE r <= 2""")
def user_windows(spark, sf):
    n = T.norm_text(F.col("text"))
    return D.user_windows(V.turns(spark, sf), F.length(n).between(4, 400) & ~T.contains_any(n, ["disgusting"]))


@register("classifier_window", f"SELECT conv_id, turn, string_agg('[USER] ' || {_S}, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS \"window\" FROM conversations WHERE role = 'user'")
def classifier_window(spark, sf):
    return D.classifier_window(V.turns(spark, sf))


@register("pick_best_utterance", f"""WITH t AS (SELECT conv_id, turn, {_N} AS t, length({_N}) BETWEEN 10 AND 900 AS good FROM conversations), s AS (SELECT *, lag(good) OVER w AS bg, lag(t) OVER w AS bt, length(t) + CASE WHEN contains(t, '?') THEN 3 ELSE 0 END AS score FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS r FROM s WHERE good) SELECT conv_id, turn, CASE WHEN bg THEN '上文：' || bt || chr(10) || '用户：' || t ELSE t END AS sample FROM r WHERE r = 1""")
def pick_best_utterance(spark, sf):
    return D.pick_best_utterance(V.turns(spark, sf), F.length(T.norm_text(F.col("text"))).between(10, 900))


@register("select_timepoints", f"""WITH {_PAIRS}, n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN pair_idx = n - 1 THEN 0 WHEN pair_idx = n // 2 THEN 1 ELSE 2 END, md5('42|' || conv_id || '|' || pair_idx), pair_idx) AS r FROM n)
SELECT conv_id, pair_idx, user_turn, user_text, assistant_text FROM r WHERE r <= 2""")
def select_timepoints(spark, sf):
    return D.select_timepoints(D.pair_turns(V.turns(spark, sf)), 2)


@register("prompt_prefix", f"""WITH p AS (SELECT conv_id, turn, role, string_agg(role || ': ' || {_S}, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS prompt, lead(role) OVER w AS nr, lead({_S}) OVER w AS chosen
FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, prompt, length(prompt) AS prompt_chars, chosen FROM p WHERE role = 'user' AND nr = 'assistant' AND length(prompt) <= 2500 AND length(chosen) <= 1200 AND length(prompt) + length(chosen) <= 3000""")
def prompt_prefix(spark, sf):
    return D.prompt_prefix(V.turns(spark, sf), 4, 2500, 1200, 3000)


@register("format_dialog", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')),
d AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'U: ' ELSE 'A: ' END || {_S}, chr(10) ORDER BY turn) AS d FROM r WHERE r <= 4 GROUP BY conv_id) SELECT conv_id, CASE WHEN length(d) > 600 THEN right(d, 600) ELSE d END AS dialog FROM d""")
def format_dialog(spark, sf):
    return D.format_dialog(V.turns(spark, sf), {"user": "U: ", "assistant": "A: "}, 4, 600)


@register("recent_window", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn, role, text FROM r WHERE r <= 4 AND role IN ('user', 'assistant')")
def recent_window(spark, sf):
    return D.recent_window(V.turns(spark, sf), 4)


@register("since_watermark", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 0 OR turn > conv_id % 4")
def since_watermark(spark, sf):
    t = V.turns(spark, sf)
    marks = t.where("conv_id % 3 = 0").select("conv_id", (F.col("conv_id") % 4).alias("last_turn")).distinct()
    return D.since_watermark(t, marks)


@register("assign_turns", f"WITH {V.MESSAGES_SQL} SELECT message_id, user_id, position, turn_id, reply_to_message_id, is_final, is_deleted FROM msgs")
def assign_turns(spark, sf):
    return V.messages(spark, sf).select("message_id", "user_id", "position", "turn_id", "reply_to_message_id", "is_final", "is_deleted")


_SIGNALS = ["the", "und", "les", "los", "que"]


@register("conversation_score", f"""WITH g AS (SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS user_chars,
{' + '.join(f"coalesce(CAST(bool_or(contains(text, '{t}')) FILTER (role = 'user') AS BIGINT), 0)" for t in _SIGNALS)} AS signals FROM conversations GROUP BY conv_id)
SELECT *, 100 * signals + user_chars AS score FROM g WHERE n_messages >= 4 AND user_turns >= 2 AND user_chars >= 150 AND signals >= 2""")
def conversation_score(spark, sf):
    return D.conversation_score(V.turns(spark, sf), _SIGNALS, 4, 2, 150, 2)


# --- keys, exclusion, deduplication, splits

_SIG = f"""sig AS (SELECT conv_id, sha1(string_agg(role || ':' || {_K}, '|' ORDER BY turn)) AS signature FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 6 AND {_K} <> '' GROUP BY conv_id)"""


@register("conversation_signature", f"WITH {_SIG} SELECT * FROM sig")
def conversation_signature(spark, sf):
    return K.conversation_signature(V.turns(spark, sf))


@register("seen_unseen", f"WITH {_SIG} SELECT conv_id, signature, CASE WHEN conv_id % 3 = 0 THEN 'seen' ELSE 'unseen' END AS exposure FROM sig WHERE conv_id % 3 = 0 OR conv_id % 5 <> 0")
def seen_unseen(spark, sf):
    t = V.turns(spark, sf)
    human = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    sig = K.conversation_signature(t)
    used = lambda k: K.conversation_signature(t.where(f"conv_id % {k} = 0").withColumn("role", human))
    return K.seen_unseen(sig, used(3), used(5)).select("conv_id", "signature", "exposure")


@register("exclude_used", f"WITH {_PAIRS} SELECT * FROM pairs WHERE NOT (conv_id % 2 = 0 AND pair_idx = 0)")
def exclude_used(spark, sf):
    p = D.pair_turns(V.turns(spark, sf))
    return K.exclude_used(p, p.where("conv_id % 2 = 0 and pair_idx = 0"), ["conv_id", "pair_idx"]).select(*p.columns)


@register("dedup_by_hash", "SELECT min(doc_id) AS doc_id, sha1(text) AS content_hash FROM documents GROUP BY text")
def dedup_by_hash(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    return K.first_per_key(d, F.col("content_hash"), ["doc_id"])


@register("dedup_text", "SELECT source, text_key, min(doc_id) AS doc_id FROM (SELECT source, doc_id, md5(" + _K + ") AS text_key FROM documents) GROUP BY source, text_key")
def dedup_text(spark, sf):
    d = V.table(spark, sf, "documents").select("source", "doc_id", F.md5(T.norm_key(F.col("text")).cast("binary")).alias("text_key"))
    return d.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"))


@register("compact_latest", "SELECT user_id % 50 AS id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def compact_latest(spark, sf):
    e = V.table(spark, sf, "events").select((F.col("user_id") % 50).alias("id"), "event_id", "event_type")
    return K.compact_latest(e, "id", "event_id").select("id", "event_type", "first_seq")


@register("hash_split", f"SELECT doc_id, {_split('13', 'doc_id')} AS split, {_split('13', 'source', 800, 900, 1000)} AS source_split FROM documents")
def hash_split(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", K.hash_split("13", F.col("doc_id")).alias("split"), K.hash_split("13", F.col("source"), 800, 900, 1000).alias("source_split"))


@register("append_new_until", f"""WITH e AS (SELECT doc_id, {_K} AS k FROM documents WHERE doc_id % 4 = 0), c AS (SELECT min(doc_id) AS doc_id, k FROM (SELECT doc_id, {_K} AS k FROM documents WHERE doc_id % 4 <> 0) WHERE k NOT IN (SELECT k FROM e) GROUP BY k)
SELECT doc_id FROM e UNION ALL SELECT doc_id FROM (SELECT doc_id FROM c ORDER BY doc_id LIMIT (SELECT greatest(0, 400 - count(*)) FROM e))""")
def append_new_until(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.md5(T.norm_key(F.col("text")).cast("binary")).alias("k"))
    return K.append_new_until(d.where("doc_id % 4 = 0"), d.where("doc_id % 4 <> 0"), "k", [F.col("doc_id")], 400).select("doc_id")


@register("duplicate_sessions", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def duplicate_sessions(spark, sf):
    return K.duplicate_sessions(V.table(spark, sf, "documents").select("text"))


@register("owned_sources", f"WITH {V.MESSAGES_SQL}, ops AS (SELECT message_id AS source_message_id, (conversation_id + message_id % 3 // 2) % 20 AS user_id FROM msgs) SELECT o.* FROM ops o WHERE EXISTS (SELECT 1 FROM msgs m WHERE m.message_id = o.source_message_id AND m.user_id = o.user_id AND role = 'user' AND NOT is_deleted)")
def owned_sources(spark, sf):
    m = V.messages(spark, sf)
    ops = m.select(F.col("message_id").alias("source_message_id"), ((F.col("conversation_id") + F.floor(F.col("message_id") % 3 / 2)) % 20).alias("user_id"))
    return K.owned_sources(ops, m).select("source_message_id", "user_id")


@register("neighbour_range", f"WITH {V.MESSAGES_SQL} SELECT a.message_id AS anchor_id, m.message_id, m.position - a.position AS distance FROM msgs a JOIN msgs m USING (conversation_id) WHERE a.message_id % 5 = 0 AND m.position BETWEEN a.position - 2 AND a.position + 1")
def neighbour_range(spark, sf):
    m = V.messages(spark, sf)
    return K.neighbour_range(m.where("message_id % 5 = 0"), m, 2, 1)


# --- labels and text measures


@register("rule_labels", f"SELECT conv_id, turn, {_first('n', V.RISK, 'R0')} AS risk, {_first('n', V.EMOTION, 'none')} AS emotion, {_first('k', V.TOPICS, 'other')} AS topic, contains(n, 'the') OR contains(n, 'and') AS domain, len(regexp_extract_all(n, 'the|and')) + CAST(contains(n, 'and') AS INTEGER) AS domain_score, regexp_matches(text, 'd.r') AS strict FROM (SELECT *, {_N} AS n, {_K} AS k FROM conversations)")
def rule_labels(spark, sf):
    c = F.col("text")
    return V.turns(spark, sf).select("conv_id", "turn", L.risk_level(c, V.RISK).alias("risk"), L.emotion(c, V.EMOTION, "none").alias("emotion"), L.topic_bucket(c, V.TOPICS).alias("topic"), L.domain_flag(c, V.DOMAIN).alias("domain"), L.domain_score(c, V.DOMAIN, ["and"]).alias("domain_score"), L.strict_match(c, "d.r").alias("strict"))


_SAMPLES = """samples AS (SELECT doc_id AS id, lang AS input, '{"is_consult":' || (doc_id % 2) || ',"risk":"R' || (doc_id % 4) || '","emotion":"' || source || '"}' AS output FROM documents)"""


def _samples(spark, sf):
    out = F.concat(F.lit('{"is_consult":'), F.col("doc_id") % 2, F.lit(',"risk":"R'), F.col("doc_id") % 4, F.lit('","emotion":"'), "source", F.lit('"}'))
    return V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("input"), out.alias("output"))


@register("derive_labels", f"""WITH {_SAMPLES} SELECT id, input, task, label, 'mother' AS derived_from FROM (SELECT id, input, 'intent' AS task, output->>'$.is_consult' AS label FROM samples UNION ALL SELECT id, input, 'risk', output->>'$.risk' FROM samples WHERE output->>'$.is_consult' = '1'
UNION ALL SELECT id, input, 'emotion', output->>'$.emotion' FROM samples WHERE output->>'$.is_consult' = '1') WHERE label IS NOT NULL""")
def derive_labels(spark, sf):
    return L.derive_labels(_samples(spark, sf))


@register("remap_labels", f"WITH {_SAMPLES} SELECT id, CASE output->>'$.risk' WHEN 'R1' THEN 'R0' WHEN 'R2' THEN 'R1' WHEN 'R3' THEN 'R2' ELSE 'R0' END AS risk, 'level ' || CASE output->>'$.risk' WHEN 'R1' THEN 'R0' WHEN 'R2' THEN 'R1' WHEN 'R3' THEN 'R2' ELSE 'R0' END AS note, output->>'$.risk' <> 'R0' AS changed FROM samples")
def remap_labels(spark, sf):
    s = _samples(spark, sf)
    s = s.select("id", L.get_label(s, "risk").alias("risk")).withColumn("note", F.concat(F.lit("level "), "risk"))
    return L.remap_labels(s, columns=("risk",), texts=("note",))


_CHOICE = "coalesce(nullif(regexp_extract(upper({0}), '(?:^|[^A-Z])([A-E])(?:[^A-Z]|$)', 1), ''), nullif(regexp_extract(upper({0}), '^([A-E])', 1), ''))"


@register("text_measures", f"""SELECT conv_id, turn, {_N} AS norm, md5({_K}) AS key_hash, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS n_cjk, len(regexp_extract_all(text, '[A-Za-z]')) AS n_ascii, {V.TOKENS_SQL.format('text')} AS tokens,
greatest(1, CAST(floor(length(text) / 1.5) AS BIGINT)) AS tokens_evidence, CASE role WHEN 'user' THEN '[U]' WHEN 'assistant' THEN '[A]' ELSE role END || chr(10) || text AS searchable,
CASE WHEN length({_S.replace('text', "replace(text, chr(10), ' ')")}) <= 40 THEN {_S.replace('text', "replace(text, chr(10), ' ')")} ELSE substr({_S.replace('text', "replace(text, chr(10), ' ')")}, 1, 39) || '…' END AS snippet,
replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_words, 'u_' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 8) AS user_hash,
{_CHOICE.format(_S)} AS choice, strftime(make_timestamp((1700000000 + conv_id * 3600) * 1000000), '%Y-%m-%d') AS day FROM conversations""")
def text_measures(spark, sf):
    c = F.col("text")
    return V.turns(spark, sf).select(
        "conv_id", "turn", T.norm_text(c).alias("norm"), F.md5(T.norm_key(c).cast("binary")).alias("key_hash"), T.count_cjk(c).cast("long").alias("n_cjk"), T.count_ascii_letters(c).cast("long").alias("n_ascii"), T.count_tokens(c).alias("tokens"),
        T.estimate_tokens(c).alias("tokens_evidence"), T.searchable_text(F.col("role"), c, {"user": "[U]", "assistant": "[A]"}).alias("searchable"), T.snippet(c, 40).alias("snippet"), T.html_escape(c).alias("escaped"), F.size(T.words(c)).cast("long").alias("n_words"),
        T.user_hash(F.col("conv_id")).alias("user_hash"), T.extract_choice(c).alias("choice"), T.date_label(F.lit(1_700_000_000) + F.col("conv_id") * 3600).alias("day"),
    )


_GRAMS = "list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])"
_TIGHT = f"regexp_replace({_S}, '\\s+', '', 'g')"


@register("repetition_score", f"""SELECT doc_id, round(CASE WHEN length(t) = 0 THEN -1e9 ELSE least(length(t), 400) / 400.0 - 0.06 * least(len(regexp_extract_all(t, '[?？]')), 6) - 1.2 * least(CASE WHEN len(c) < 12 THEN 0 ELSE 1 - len(list_distinct({_GRAMS})) / len({_GRAMS}) END, 0.4) END, 9) AS score FROM (SELECT doc_id, {_S} AS t, string_split({_TIGHT}, '') AS c FROM documents)""")
def repetition_score(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.round(T.repetition_score(F.col("text")), 9).alias("score"))


def _pii_sql() -> str:
    """The library's patterns without look-arounds, which the other engine doesn't have: the characters around are matched
    and put back, and each pattern runs twice for neighbours that share one."""
    out = "coalesce(text, '')"
    for pattern, tag in T.PII.items():
        if pattern.startswith("(?<!"):
            core = pattern.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
            for _ in range(2):
                out = f"regexp_replace({out}, '(^|[^0-9])(?:{core})($|[^0-9])', '\\1{tag}\\2', 'g')"
        else:
            out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    return out


@register("redact_email", f"SELECT doc_id, {_pii_sql()} AS text FROM documents")
def redact_email(spark, sf):
    """redact_pii over all documents: addresses, phone numbers and id numbers."""
    return V.table(spark, sf, "documents").select("doc_id", T.redact_pii(F.col("text")).alias("text"))


@register("session_cosine", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND b.vec_id = a.vec_id + 10""")
def session_cosine(spark, sf):
    e = V.table(spark, sf, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("va"), (F.col("vec_id") + 10).alias("b")).join(e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("vb")), ["b", "label"])
    return pairs.select("a", "b", F.round(T.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))
