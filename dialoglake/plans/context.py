"""Queries of fragments, spans, windows and profile replay: from hits to what a prompt holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators import fragments as G
from dialoglake.operators import profiles as P
from dialoglake.operators import spans as S
from dialoglake.plans import views as V
from dialoglake.plans.catalog import register

_TOK = V.TOKENS_SQL
_M = V.MESSAGES_SQL

# --- fragments: every fourth message is hit, whole or in some of its segments of 200 characters

_FRAGMENTS = f"""WITH {_M}, mm AS (SELECT *, (message_id * 7 % 10) / 10.0 AS sim, message_id % 11 = 0 AS excluded FROM msgs),
sg AS (SELECT message_id, i AS segment_index, substr(content, i * 200 + 1, 200) AS content, ((message_id + i * 3) % 10) / 10.0 AS sim FROM (SELECT message_id, content, unnest(range((length(content) + 199) // 200)) AS i FROM mm)),
h AS (SELECT conversation_id % 10 AS query_id, message_id, s.s AS segment_index, (message_id * 13 % 97 + coalesce(s.s, 0)) / 97.0 AS score FROM mm, (VALUES (NULL), (0), (1), (3)) s(s)
    WHERE message_id % 4 = 0 AND NOT excluded AND CASE WHEN s.s IS NULL THEN message_id % 8 = 0 ELSE length(content) > s.s * 200 END),
whole AS (SELECT query_id, message_id, max(score) AS score FROM h WHERE segment_index IS NULL GROUP BY 1, 2),
sh AS (SELECT query_id, message_id, segment_index, max(score) AS score FROM h ANTI JOIN whole USING (query_id, message_id) GROUP BY 1, 2, 3),
runs AS (SELECT query_id, message_id, min(segment_index) AS a, max(segment_index) AS b, max(score) AS score FROM (SELECT *, segment_index - row_number() OVER (PARTITION BY query_id, message_id ORDER BY segment_index) AS run FROM sh) GROUP BY query_id, message_id, run),
reg AS (SELECT query_id, message_id, NULL AS a, NULL AS b, score FROM whole UNION ALL SELECT query_id, message_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, message_id ORDER BY score DESC, a) AS r FROM runs) WHERE r = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, message_id) AS r FROM reg) WHERE r <= 10),
nb AS (SELECT t.query_id, t.message_id, m.message_id AS nid, m.position, m.content, m.position < c.position AS before, abs(m.position - c.position) AS dist, m.sim FROM top t JOIN mm c USING (message_id) JOIN mm m ON m.conversation_id = c.conversation_id
    WHERE t.a IS NULL AND m.position <> c.position AND abs(m.position - c.position) <= 8 AND m.role = 'user' AND NOT m.excluded),
nk AS (SELECT * FROM (SELECT *, bool_and(sim >= 0.4) OVER w AS ok, row_number() OVER w AS rr FROM nb WINDOW w AS (PARTITION BY query_id, message_id, before ORDER BY dist ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE ok AND rr <= 2),
parts AS (SELECT t.query_id, t.message_id, 'core' AS kind, 0 AS place, t.message_id AS id, m.content FROM top t JOIN mm m USING (message_id) WHERE t.a IS NULL
    UNION ALL SELECT query_id, message_id, CASE WHEN before THEN 'earlier' ELSE 'later' END, position, nid, content FROM nk
    UNION ALL SELECT t.query_id, t.message_id, CASE WHEN s.segment_index < a THEN 'earlier' WHEN s.segment_index > b THEN 'later' ELSE 'core' END, s.segment_index, s.segment_index, s.content FROM top t JOIN sg s ON s.message_id = t.message_id AND s.segment_index BETWEEN a - 1 AND b + 1 WHERE s.segment_index BETWEEN a AND b OR s.sim >= 0.4),
fr AS (SELECT query_id, message_id, {', '.join(f"coalesce(list({{'id': id, 'content': content}} ORDER BY place) FILTER (kind = '{k}'), []) AS {k}" for k in ('core', 'earlier', 'later'))}, min(id) AS first, max(id) AS last FROM parts GROUP BY 1, 2),
f AS (SELECT fr.*, t.a IS NULL AS whole, t.score, r.message_id AS reply_id, coalesce(r.content, '') AS reply, t.a IS NOT NULL AND first > 0 AS omitted_before, t.a IS NOT NULL AND last < (SELECT max(segment_index) FROM sg WHERE sg.message_id = fr.message_id) AS omitted_after
    FROM fr JOIN top t USING (query_id, message_id) JOIN mm m USING (message_id) LEFT JOIN mm r ON m.role = 'assistant' AND r.message_id = m.reply_to_message_id AND NOT r.excluded)"""


def _fragments(spark, sf):
    m = V.messages(spark, sf).withColumns({"sim": (F.col("message_id") * 7 % 10) / 10.0, "excluded": F.col("message_id") % 11 == 0})
    cut = m.select("message_id", F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 200).cast("int"))).alias("segment_index"), "content").where("content <> ''")
    segments = cut.select("message_id", "segment_index", F.expr("substring(content, segment_index * 200 + 1, 200)").alias("content"), ((F.col("message_id") + F.col("segment_index") * 3) % 10 / 10.0).alias("sim"))
    s = F.explode(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(1), F.lit(3)))
    hits = m.where("message_id % 4 = 0").select("message_id", (F.col("conversation_id") % 10).alias("query_id"), F.length("content").alias("n"), s.alias("segment_index"))
    hits = hits.where("case when segment_index is null then message_id % 8 = 0 else n > segment_index * 200 end").withColumn("score", (F.col("message_id") * 13 % 97 + F.coalesce("segment_index", F.lit(0))) / 97.0)
    return G.build_fragments(hits.drop("n"), m, segments)


@register("build_fragments", f"""{_FRAGMENTS} SELECT query_id, message_id, CASE WHEN whole THEN 'message' ELSE 'segment' END AS fragment_type, round(score, 9) AS score,
{', '.join(f"array_to_string(list_transform({k}, lambda x: x.id), ',') AS {k}" for k in ('core', 'earlier', 'later'))}, reply_id, omitted_before, omitted_after FROM f""")
def build_fragments(spark, sf):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ",").alias(c)
    return _fragments(spark, sf).select("query_id", "message_id", "fragment_type", F.round("score", 9).alias("score"), ids("core"), ids("earlier"), ids("later"), "reply_id", "omitted_before", "omitted_after")


def _sum_sql(sizes: str) -> str:
    return f"coalesce(list_sum({sizes}), 0)"


@register("trim_fragments", f"""{_FRAGMENTS}, z AS (SELECT *, {', '.join(f"list_transform({k}, lambda x: {_TOK.format('x.content')}) AS {k[0]}s" for k in ('core', 'earlier', 'later'))}, CASE WHEN whole THEN 300 ELSE 130 END AS budget, {_TOK.format('reply')} AS rt FROM f),
y AS (SELECT *, {_sum_sql('cs')} AS ct, {_sum_sql('es')} AS et, budget - {_sum_sql('cs')} - rt AS room, CASE WHEN rt <= 40 THEN reply ELSE substr(reply, 1, 24) || '…' || right(reply, 16) END AS short FROM z),
x AS (SELECT *, CASE WHEN room >= et THEN len(list_filter(range(1, len(ls) + 1), lambda i: list_sum(list_slice(ls, 1, i)) <= room - et)) ELSE 0 END AS n_later,
    CASE WHEN room >= et THEN len(es) ELSE len(list_filter(range(1, len(es) + 1), lambda i: list_sum(list_slice(list_reverse(es), 1, i)) <= room)) END AS n_earlier,
    CASE WHEN room >= 0 THEN reply WHEN ct + {_TOK.format('short')} <= budget THEN short ELSE '' END AS new_reply, CASE WHEN whole AND ct > budget THEN [substr(core[1].content, 1, 90) || '…' || right(core[1].content, 60)] ELSE list_transform(core, lambda v: v.content) END AS new_core FROM y)
SELECT query_id, message_id, array_to_string(new_core, '|') AS core, CAST(n_earlier AS BIGINT) AS n_earlier, CAST(n_later AS BIGINT) AS n_later, new_reply AS reply, CAST(len(es) - n_earlier + len(ls) - n_later AS BIGINT) AS dropped,
CAST({_sum_sql(f"list_transform(new_core, lambda v: {_TOK.format('v')})")} + {_sum_sql('list_slice(list_reverse(es), 1, n_earlier)')} + {_sum_sql('list_slice(ls, 1, n_later)')} + {_TOK.format('new_reply')} AS BIGINT) AS token_count FROM x""")
def trim_fragments(spark, sf):
    t = G.trim_fragments(_fragments(spark, sf), 300, 130, 40)
    long = lambda c: F.size(c).cast("long")
    return t.select("query_id", "message_id", F.array_join(F.transform("core", lambda x: x["content"]), "|").alias("core"), long("earlier").alias("n_earlier"), long("later").alias("n_later"), "reply", F.col("dropped").cast("long").alias("dropped"), "token_count")


@register("render_fragments", f"""{_FRAGMENTS}, t AS (SELECT query_id, message_id, m.created_at, array_to_string(list_concat(list_concat(CASE WHEN reply <> '' THEN [reply] ELSE [] END, CASE WHEN omitted_before THEN ['…'] ELSE [] END), list_concat(list_transform(list_concat(list_concat(earlier, core), later), lambda x: x.content), CASE WHEN omitted_after THEN ['…'] ELSE [] END)), chr(10)) AS body FROM f JOIN msgs m USING (message_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at, message_id) AS i FROM t)
SELECT query_id, count(*) AS n, string_agg('<memory index="' || i || '" date="' || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') || '">' || chr(10) || replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</memory>', chr(10) ORDER BY i) AS rendered FROM n GROUP BY query_id""")
def render_fragments(spark, sf):
    return S.render_fragments(_fragments(spark, sf))


# --- spans: every third message is an anchor with the messages one and four places after it


@register("merge_spans", f"""WITH RECURSIVE {_M}, sp AS (SELECT message_id AS span_id, conversation_id, position, (message_id % 7) / 7.0 AS fused, (message_id % 5) / 5.0 AS rerank, ['q' || message_id % 4, 'q' || message_id % 3] AS queries FROM msgs WHERE message_id % 3 = 0),
tn AS (SELECT s.span_id, s.conversation_id, m.position, m.message_id, m.message_id = s.span_id OR m.message_id % 6 = 1 AS is_anchor, CASE WHEN (m.message_id + s.span_id) % 2 = 0 THEN 'm' || s.span_id % 10 END AS matched, s.rerank, s.fused FROM sp s JOIN msgs m ON m.conversation_id = s.conversation_id AND m.position - s.position IN (0, 1, 4)),
d AS (SELECT DISTINCT a.span_id AS a, b.span_id AS b FROM tn a JOIN tn b USING (conversation_id, position)),
reach(a, b) AS (SELECT a, b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON r.b = d.a),
comp AS (SELECT a AS span_id, min(b) AS c FROM reach GROUP BY 1),
o AS (SELECT conversation_id, c, message_id, min(position) AS position, bool_or(is_anchor) AS is_anchor, coalesce(first(matched ORDER BY rerank DESC, fused DESC, span_id) FILTER (matched IS NOT NULL AND is_anchor), first(matched ORDER BY rerank DESC, fused DESC, span_id) FILTER (matched IS NOT NULL)) AS matched FROM tn JOIN comp USING (span_id) GROUP BY 1, 2, 3),
k AS (SELECT *, avg(position) FILTER (is_anchor) OVER w AS centre, count(*) FILTER (is_anchor) OVER w AS n_anchors, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY c)),
r AS (SELECT *, row_number() OVER (PARTITION BY c, is_anchor ORDER BY abs(position - centre), position) AS near FROM k),
kept AS (SELECT conversation_id, c, string_agg(message_id || CASE WHEN is_anchor THEN '*' ELSE '' END || coalesce(matched, ''), ',' ORDER BY position) AS messages, list(message_id ORDER BY message_id) FILTER (is_anchor) AS ids FROM r WHERE n <= 4 OR is_anchor OR near <= greatest(0, 4 - n_anchors) GROUP BY 1, 2),
qs AS (SELECT c, list(q ORDER BY first_at) AS qs FROM (SELECT c, q, min(o) AS first_at FROM (SELECT c, unnest(queries) AS q, row_number() OVER (PARTITION BY c ORDER BY rerank DESC, fused DESC, span_id) * 10 + unnest(range(2)) AS o FROM sp JOIN comp USING (span_id)) GROUP BY 1, 2) GROUP BY 1)
SELECT conversation_id, 'c' || conversation_id || '-' || array_to_string(list_slice(ids, 1, 4), '-') AS bundle_id, messages, round((SELECT max(fused) FROM sp JOIN comp USING (span_id) WHERE comp.c = kept.c), 9) AS fused, round((SELECT max(rerank) FROM sp JOIN comp USING (span_id) WHERE comp.c = kept.c), 9) AS rerank, array_to_string(qs, ',') AS queries FROM kept JOIN qs USING (c)""")
def merge_spans(spark, sf):
    m = V.messages(spark, sf)
    a = m.where("message_id % 3 = 0").select(F.lit(1).alias("query_id"), F.col("message_id").alias("span_id"), "conversation_id", F.col("position").alias("at"))
    q = lambda n: F.concat(F.lit("q"), (F.col("span_id") % n).cast("string"))
    spans = a.select("query_id", "span_id", "conversation_id", (F.col("span_id") % 7 / 7.0).alias("fused"), (F.col("span_id") % 5 / 5.0).alias("rerank"), F.array(q(4), q(3)).alias("queries"))
    t = a.withColumn("position", F.explode(F.array(*(F.col("at") + k for k in (0, 1, 4))))).join(m.select("conversation_id", "position", "message_id"), ["conversation_id", "position"])
    matched = F.when((F.col("message_id") + F.col("span_id")) % 2 == 0, F.concat(F.lit("m"), (F.col("span_id") % 10).cast("string")))
    turns = t.select("query_id", "span_id", "position", "message_id", ((F.col("message_id") == F.col("span_id")) | (F.col("message_id") % 6 == 1)).alias("is_anchor"), matched.alias("matched"))
    one = lambda x: F.concat(x["message_id"].cast("string"), F.when(x["is_anchor"], "*").otherwise(""), F.coalesce(x["matched"], F.lit("")))
    return S.merge_spans(spans, turns, 4).select("conversation_id", "bundle_id", F.array_join(F.transform("messages", one), ",").alias("messages"), F.round("fused", 9).alias("fused"), F.round("rerank", 9).alias("rerank"), F.array_join("queries", ",").alias("queries"))


# --- profiles: every user message proposes a fact, some an update or a deletion of what an earlier message added

_REPLAY = f"""WITH RECURSIVE {_M}, um AS (SELECT user_id, message_id, created_at, row_number() OVER w AS k, lag(message_id, 2) OVER w * 10 AS t2, lag(message_id, 3) OVER w * 10 AS t3, message_id % 10 = 0 AS done, 'f' || message_id % 11 || '.' AS ac, 'u' || message_id % 7 || '.' AS uc
    FROM msgs WHERE role = 'user' AND NOT is_deleted WINDOW w AS (PARTITION BY user_id ORDER BY message_id)),
st(user_id, k, items) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), [{{'at': user_id, 'id': user_id, 'content': 'first fact.'}}, {{'at': user_id, 'id': user_id + 100000000000, 'content': 'f3.'}}] FROM msgs
    UNION ALL SELECT user_id, k + 1, list_slice(v, greatest(1, len(v) - 5), len(v)) FROM (
        SELECT user_id, k, list_sort(list_concat(list_transform(list_filter(items, lambda x: NOT (d_ok AND x.id = t3)), lambda x: CASE WHEN u_ok AND x.id = t2 THEN {{'at': x.at, 'id': x.id, 'content': uc}} ELSE x END), CASE WHEN a_ok THEN [{{'at': created_at, 'id': message_id * 10, 'content': ac}}] ELSE [] END)) AS v FROM (
            SELECT st.user_id, st.k, items, t2, t3, ac, uc, created_at, message_id, NOT done AND NOT list_contains(list_transform(items, lambda x: x.content), ac) AS a_ok,
                NOT done AND message_id % 3 = 0 AND coalesce(list_contains(list_transform(items, lambda x: x.id), t2), FALSE) AND NOT list_contains(list_transform(items, lambda x: x.content), uc) AS u_ok,
                NOT done AND message_id % 4 = 0 AND coalesce(list_contains(list_transform(items, lambda x: x.id), t3), FALSE) AS d_ok
            FROM st JOIN um ON um.user_id = st.user_id AND um.k = st.k + 1)))"""


def _replay(spark, sf):
    from pyspark.sql.window import Window

    m = V.messages(spark, sf)
    users = m.select("user_id").distinct()
    fact = lambda i, c: users.select(i.alias("id"), "user_id", F.lit(c).alias("content"), F.lit("active").alias("status"), F.col("user_id").alias("created_at"))
    have = fact(F.col("user_id"), "first fact.").unionByName(fact(F.col("user_id") + 100_000_000_000, "f3."))
    w = Window.partitionBy("user_id").orderBy("message_id")
    u = m.where("role = 'user' and not is_deleted").select("user_id", "message_id", "content", (F.lag("message_id", 2).over(w) * 10).alias("t2"), (F.lag("message_id", 3).over(w) * 10).alias("t3"))
    named = lambda letter, n: F.concat(F.lit(letter), (F.col("message_id") % n).cast("string"), F.lit("."))
    op = lambda no, kind, target, content: F.struct(F.lit(no).alias("op_no"), F.lit(kind).alias("op"), target.cast("long").alias("target_id"), content.alias("content"))
    each = F.array_compact(F.array(op(0, "add", F.lit(None), named("f", 11)), F.when(F.col("message_id") % 3 == 0, op(1, "update", F.col("t2"), named("u", 7))), F.when(F.col("message_id") % 4 == 0, op(2, "delete", F.col("t3"), F.lit("")))))
    ops = u.select("user_id", "message_id", F.explode(each).alias("o")).select("user_id", "message_id", "o.*")
    ledger = u.where("message_id % 10 = 0").select("user_id", "message_id", F.sha2("content", 256).alias("content_hash"))
    return P.apply_ops(have, ops, m, ledger, most_items=6)


@register("apply_ops", f"{_REPLAY}, fin AS (SELECT user_id, unnest(items) AS x FROM (SELECT user_id, arg_max(items, k) AS items FROM st GROUP BY 1)) SELECT user_id, x.id AS id, x.content AS content, x.at AS created_at FROM fin")
def apply_ops(spark, sf):
    """Several messages a user, replayed in order; what is active in the end."""
    return _replay(spark, sf).where("status = 'active'").select("user_id", "id", "content", "created_at")


@register("new_ledger_rows", f"WITH {_M} SELECT user_id, message_id, sha256(content) AS content_hash FROM msgs WHERE role = 'user' AND NOT is_deleted AND message_id % 10 <> 0")
def new_ledger_rows(spark, sf):
    m = V.messages(spark, sf)
    return P.new_ledger_rows(m, m.where("message_id % 10 = 0").select("user_id", "message_id", F.sha2("content", 256).alias("content_hash")))


# --- windows of four turns a conversation, packed and rendered

_HEAD = f"{G.TODAY.format('2026-01-01')}\n{G.NOTICE}"
_WINDOWS = f"""WITH RECURSIVE {_M}, tr AS (SELECT *, conversation_id * 100 + (position - 1) // 4 AS window_id, CASE position % 4 WHEN 1 THEN 'earlier' WHEN 0 THEN 'later' ELSE 'anchor' END AS section FROM msgs),
ln AS (SELECT *, trim(replace(content, chr(10), ' ')) AS c, CASE WHEN section = 'anchor' THEN {G.ANCHOR_CHARS} ELSE {G.OTHER_CHARS} END AS lim, coalesce(lag(section) OVER (PARTITION BY window_id ORDER BY position), '') <> section AS begins FROM tr),
sd AS (SELECT *, CASE WHEN begins THEN CASE section {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SECTIONS.items())} END || chr(10) ELSE '' END || CASE WHEN section = 'anchor' THEN '★ ' ELSE '' END || CASE WHEN role = 'user' THEN '{G.ROLES[0]}' ELSE '{G.ROLES[1]}' END || '（' || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') || '）：' ||
    replace(replace(replace(CASE WHEN length(c) <= lim THEN c ELSE '…' || right(c, lim) END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS said FROM ln),
w AS (SELECT conversation_id AS query_id, window_id, min(created_at) AS starts_at, '">' || chr(10) || string_agg(said, chr(10) ORDER BY position) || chr(10) || '</retrieved_memory>' || chr(10) AS body FROM sd GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (window_id * 7 % 5) / 5.0 DESC, window_id) AS k FROM w),
pk(query_id, k, texts, taken, left_out) AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM rk
    UNION ALL SELECT query_id, k + 1, CASE WHEN ok THEN list_append(texts, body) ELSE texts END, CASE WHEN ok THEN list_append(taken, window_id) ELSE taken END, CASE WHEN ok THEN left_out ELSE list_append(left_out, window_id) END FROM (
        SELECT pk.*, body, window_id, {_TOK.format('block')} <= 500 AS ok FROM (SELECT pk.*, rk.body, rk.window_id,
            '<episodic_memory>' || chr(10) || $head$ || list_aggregate(list_transform(list_append(texts, rk.body), lambda t, i: chr(10) || chr(10) || '<retrieved_memory index="' || i || t), 'string_agg', '') || '</episodic_memory>' AS block
            FROM pk JOIN rk ON rk.query_id = pk.query_id AND rk.k = pk.k + 1) pk)),
fin AS (SELECT query_id, arg_max(taken, k) AS taken, arg_max(left_out, k) AS left_out FROM pk GROUP BY 1),
bl AS (SELECT f.query_id, string_agg(chr(10) || chr(10) || '<retrieved_memory index="' || i || body, '' ORDER BY i) AS t FROM (SELECT f.query_id, body, row_number() OVER (PARTITION BY f.query_id ORDER BY starts_at, window_id) AS i FROM fin f JOIN w USING (query_id) WHERE list_contains(taken, window_id)) f GROUP BY 1)
SELECT query_id, CAST(len(taken) AS BIGINT) AS n, array_to_string(left_out, ',') AS left_out, coalesce('<episodic_memory>' || chr(10) || $head$ || t || '</episodic_memory>', '') AS rendered FROM fin LEFT JOIN bl USING (query_id)""".replace("$head$", "'" + _HEAD.replace("\n", "' || chr(10) || '") + "'")


@register("render_windows", _WINDOWS)
def render_windows(spark, sf):
    m = V.messages(spark, sf).withColumn("window_id", F.col("conversation_id") * 100 + F.floor((F.col("position") - 1) / 4))
    section = F.when(F.col("position") % 4 == 1, "earlier").when(F.col("position") % 4 == 0, "later").otherwise("anchor")
    turns = m.select(F.col("conversation_id").alias("query_id"), "window_id", "position", "message_id", "role", "created_at", "content", section.alias("section"), (section == "anchor").alias("is_anchor"), F.lit(None).cast("string").alias("matched"))
    windows = m.select(F.col("conversation_id").alias("query_id"), "window_id", "conversation_id", (F.col("window_id") * 7 % 5 / 5.0).alias("score")).distinct()
    out = G.render_windows(windows, turns, "2026-01-01", 500)
    return out.select("query_id", "n", F.array_join(F.transform("left_out", lambda x: x.cast("string")), ",").alias("left_out"), "rendered")
