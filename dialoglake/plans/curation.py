"""Queries of sampling, preference pairs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglake.functions import text as T
from dialoglake.operators import dialogue as D
from dialoglake.operators import pairs as P
from dialoglake.operators import reports as R
from dialoglake.operators import sampling as S
from dialoglake.plans import views as V
from dialoglake.plans.catalog import register
from dialoglake.plans.corpus import _ADJ, _K, _S, _first

_DOCS = "d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_H = "md5('{0}|' || doc_id)"


def _docs(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(V.table(spark, sf, "labels"), "doc_id", "left")


@register("reservoir", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_H.format(42)}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS eligible FROM d) SELECT source, doc_id, eligible FROM r WHERE r <= 5")
def reservoir(spark, sf):
    return S.reservoir(_docs(spark, sf), ["source"], "doc_id", 5).select("source", "doc_id", "eligible")


@register("quota_two_pools", f"""WITH {_DOCS}, c AS (SELECT count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM d), q AS (SELECT least(round_even(61 * 0.35, 0), a) AS wa0, a, b FROM c),
q2 AS (SELECT *, least(61 - wa0, b) AS wb FROM q), q3 AS (SELECT least(61 - wb, a) AS wa, wb FROM q2), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(9)}, doc_id) AS r FROM d WHERE quality IS NOT NULL)
SELECT doc_id, quality FROM r, q3 WHERE r <= CASE quality WHEN 1 THEN wa ELSE wb END""")
def quota_two_pools(spark, sf):
    return S.quota_two_pools(_docs(spark, sf), "quality", 1, 0, 61, 0.35, "doc_id", "9").select("doc_id", "quality")


@register("sample_until", f"""WITH {_DOCS}, s AS (SELECT * FROM d ORDER BY doc_id LIMIT 800), c AS (SELECT count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM s), q AS (SELECT least(40 - least(20, b), a) AS wa, least(40 - least(20, a), b) AS wb FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(3)}, doc_id) AS r FROM s WHERE quality IS NOT NULL) SELECT doc_id, quality FROM r, q WHERE r <= CASE quality WHEN 1 THEN wa ELSE wb END""")
def sample_until(spark, sf):
    return S.sample_until(_docs(spark, sf), [F.col("doc_id")], 800, "quality", 1, 0, 40, 0.5, "doc_id", "3").select("doc_id", "quality")


@register("first_k_per_class", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM d) SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END")
def first_k_per_class(spark, sf):
    caps = spark.createDataFrame([("en", 30), ("de", 20), ("fr", 10)], "lang string, cap int")
    return S.first_k_per_class(_docs(spark, sf), caps, ["lang"], ["doc_id"]).select("doc_id", "lang")


@register("downsample_exact", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(5)}, doc_id) AS r FROM d) SELECT doc_id, lang FROM r WHERE r <= 8")
def downsample_exact(spark, sf):
    return S.downsample_exact(_docs(spark, sf), "lang", 8, "doc_id", "5").select("doc_id", "lang")


_ORDER = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END"
_LANGS = ["en", "de", "fr", "es"]


@register("round_robin", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(42)}, doc_id) AS r FROM d) SELECT doc_id, lang, r AS pick_no FROM r ORDER BY r, {_ORDER}, lang LIMIT 50")
def round_robin(spark, sf):
    return S.round_robin(_docs(spark, sf), "lang", _LANGS, 50, "doc_id").select("doc_id", "lang", "pick_no")


@register("balanced_topics", f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(42)}, doc_id) AS r FROM d), b AS (SELECT doc_id, lang FROM r WHERE r <= 35)
SELECT * FROM b UNION ALL SELECT doc_id, lang FROM (SELECT * FROM r WHERE r > 35 ORDER BY r, {_ORDER}, lang LIMIT (SELECT 140 - count(*) FROM b))""")
def balanced_topics(spark, sf):
    return S.balanced_topics(_docs(spark, sf), "lang", _LANGS, 140, "doc_id").select("doc_id", "lang")


@register("cap_per_bucket", f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_H.format(42)}, doc_id) AS r FROM d), k AS (SELECT * FROM r WHERE r <= CASE lang WHEN 'es' THEN 5 ELSE 20 END) SELECT doc_id, lang FROM k ORDER BY {_H.format(42)}, doc_id LIMIT 50")
def cap_per_bucket(spark, sf):
    return S.cap_per_bucket(_docs(spark, sf), "lang", 20, 5, 50, "doc_id", other="es").select("doc_id", "lang")


@register("match_length", """WITH d AS (SELECT doc_id, doc_id % 3 + 1 AS n_turns, n_chars // 100 AS bin, lang = 'en' AS pos FROM documents WHERE lang IN ('en', 'de')),
r AS (SELECT *, row_number() OVER (PARTITION BY pos, n_turns, bin ORDER BY md5('42|' || doc_id), doc_id) AS p FROM d), j AS (SELECT a.n_turns, a.bin, a.p AS pick_no, a.doc_id AS pos_key, b.doc_id AS neg_key FROM r a JOIN r b ON a.pos AND NOT b.pos AND a.n_turns = b.n_turns AND a.bin = b.bin AND a.p = b.p),
t AS (SELECT *, row_number() OVER (PARTITION BY n_turns ORDER BY pick_no, bin) AS q FROM j) SELECT n_turns, bin, pick_no, pos_key, neg_key FROM t WHERE q <= CASE n_turns WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE 8 END""")
def match_length(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", (F.col("doc_id") % 3 + 1).alias("n_turns"), F.col("n_chars").alias("chars"))
    return S.match_length(d.where("lang = 'en'"), d.where("lang = 'de'"), S.largest_remainder(30, {1: 0.4, 2: 1 / 3, 3: 0.266}), "doc_id", 100)


@register("match_report", """WITH d AS (SELECT doc_id, doc_id % 3 + 1 AS n_turns, n_chars, n_chars // 100 AS bin, lang = 'en' AS pos FROM documents WHERE lang IN ('en', 'de')),
r AS (SELECT *, row_number() OVER (PARTITION BY pos, n_turns, bin ORDER BY md5('42|' || doc_id), doc_id) AS p FROM d), j AS (SELECT a.n_turns, a.bin, a.p, a.n_chars FROM r a JOIN r b ON a.pos AND NOT b.pos AND a.n_turns = b.n_turns AND a.bin = b.bin AND a.p = b.p),
t AS (SELECT *, row_number() OVER (PARTITION BY n_turns ORDER BY p, bin) AS q FROM j) SELECT n_turns, CAST(CASE n_turns WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE 8 END AS BIGINT) AS quota, count(*) AS got, count(DISTINCT bin) AS bins, avg(n_chars) AS mean_chars FROM t WHERE q <= CASE n_turns WHEN 1 THEN 12 WHEN 2 THEN 10 ELSE 8 END GROUP BY n_turns""")
def match_report(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", (F.col("doc_id") % 3 + 1).alias("n_turns"), F.col("n_chars").alias("chars"))
    quotas = {1: 12, 2: 10, 3: 8}
    return R.match_report(S.match_length(d.where("lang = 'en'"), d.where("lang = 'de'"), quotas, "doc_id", 100), d, quotas, "doc_id")


@register("top_up", """WITH p AS (SELECT doc_id, n_chars // 500 AS bin FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, bin FROM p ORDER BY CASE WHEN bin IN (1, 2) THEN 0 ELSE 1 END, md5('42|' || doc_id), doc_id LIMIT 60""")
def top_up(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.floor(F.col("n_chars") / 500).alias("bin"))
    return S.top_up(d, d.where("doc_id % 3 = 0"), spark.createDataFrame([(1,), (2,)], "bin long"), "doc_id", 60).select("doc_id", "bin")


@register("top_pool_then_sample", "WITH p AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100) SELECT * FROM p ORDER BY md5('42|' || doc_id), doc_id LIMIT 30")
def top_pool_then_sample(spark, sf):
    return S.top_pool_then_sample(_docs(spark, sf), "n_chars", "doc_id", 100, 30).select("doc_id", "n_chars")


@register("strict_pool", f"""WITH {_ADJ}, m AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM adj WHERE regexp_matches(user_text, 'the|und')), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) AS r FROM m) SELECT conv_id, turn, split FROM r WHERE r <= CASE split WHEN 'train' THEN 25 ELSE 10 END""")
def strict_pool(spark, sf):
    p = D.adjacent_pairs(V.turns(spark, sf)).where(F.col("user_text").rlike("the|und")).withColumn("split", F.when(F.col("conv_id") % 2 == 0, "train").otherwise("test"))
    caps = spark.createDataFrame([("train", 25), ("test", 10)], "split string, cap int")
    return S.first_k_per_class(p, caps, ["split"], ["conv_id", "turn"]).select("conv_id", "turn", "split")


@register("seeded_order", "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS place FROM documents")
def seeded_order(spark, sf):
    return S.seeded_order(_docs(spark, sf).select("doc_id"), "doc_id").select("doc_id", "place")


@register("write_batches", "SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // 20 AS batch_id FROM documents")
def write_batches(spark, sf):
    return S.write_batches(_docs(spark, sf).select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "batch_id")


@register("resume_filter", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def resume_filter(spark, sf):
    from dialoglake.sources.corpora import resume_filter as f

    d = _docs(spark, sf).select("doc_id")
    return f(d, d.where("doc_id % 3 = 0"), "doc_id")


# --- preference pairs

_CHOSEN = f"""{_ADJ.replace('FROM conversations', "FROM conversations WHERE role IN ('user', 'assistant')")}, ch AS (SELECT conv_id, turn, {_S.replace('text', "regexp_replace(assistant_text, '[ ]+', ' ', 'g')")} AS chosen FROM adj), cand AS (SELECT *, lower(regexp_replace(chosen, '\\s+', '', 'g')) AS k FROM ch WHERE length(lower(regexp_replace(chosen, '\\s+', '', 'g'))) >= 60)"""


@register("chosen_candidates", f"WITH {_CHOSEN} SELECT conv_id, turn, chosen FROM cand")
def chosen_candidates(spark, sf):
    return P.chosen_candidates(V.turns(spark, sf)).select("conv_id", "turn", "chosen")


@register("reject_mismatch", f"""WITH {_CHOSEN}, ring AS (SELECT k, min(chosen) AS t, row_number() OVER (ORDER BY md5('42|' || k), k) AS place, count(*) OVER () AS n FROM cand GROUP BY k), nx AS (SELECT a.k, b.t FROM ring a JOIN ring b ON b.place = a.place % a.n + 1)
SELECT conv_id, turn, t AS mismatch FROM cand JOIN nx USING (k)""")
def reject_mismatch(spark, sf):
    return P.reject_mismatch(P.chosen_candidates(V.turns(spark, sf))).select("conv_id", "turn", "mismatch")


@register("build_pairs")
def build_pairs(spark, sf):
    return P.build_pairs(P.chosen_candidates(V.turns(spark, sf)), ["It will be fine.", "Please see a doctor."]).select("id", "conv_id", "turn", "mode", "rejected")


@register("topic_balanced_pairs", f"""WITH {_CHOSEN}, c AS (SELECT conv_id, turn, {_first('k', V.TOPICS, 'other')} AS topic FROM cand WHERE conv_id % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('42|' || conv_id || ':' || turn), conv_id || ':' || turn) AS r FROM c)
SELECT conv_id, turn, topic FROM r ORDER BY r, CASE topic WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END, topic LIMIT 40""")
def topic_balanced_pairs(spark, sf):
    from dialoglake.operators.labels import topic_bucket

    c = P.chosen_candidates(V.turns(spark, sf)).withColumn("topic", topic_bucket(F.col("chosen"), V.TOPICS))
    return P.topic_balanced_pairs(c, c.where("conv_id % 4 = 0"), _LANGS, 40).select("conv_id", "turn", "topic")


_GEN = f"""gen AS (SELECT a.conv_id, a.turn, a.user_text, a.assistant_text AS chosen, CASE a.turn % 4 WHEN 0 THEN a.assistant_text WHEN 1 THEN a.user_text || ' yes' WHEN 2 THEN 'short' ELSE '' END AS reply FROM adj a)"""


def _generated(spark, sf):
    a = D.adjacent_pairs(V.turns(spark, sf))
    m = F.col("turn") % 4
    return a.withColumn("reply", F.when(m == 0, F.col("assistant_text")).when(m == 1, F.concat("user_text", F.lit(" yes"))).when(m == 2, "short").otherwise(""))


@register("generation_flags", f"""WITH {_ADJ}, {_GEN}, k AS (SELECT conv_id, turn, {_K.replace('text', 'reply')} AS r, {_K.replace('text', 'chosen')} AS c, {_K.replace('text', 'user_text')} AS u FROM gen)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN r = '' THEN 'empty' END, CASE WHEN r <> '' AND r = c THEN 'equals_chosen' END, CASE WHEN r <> '' AND u <> '' AND (contains(u, r) OR contains(r, u)) THEN 'echoes_user' END, CASE WHEN r <> '' AND length(r) < 10 THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS flags FROM k""")
def generation_flags(spark, sf):
    return _generated(spark, sf).select("conv_id", "turn", F.array_join(P.generation_flags(F.col("reply"), F.col("assistant_text"), F.col("user_text")), ",").alias("flags"))


def _flags_sql() -> str:
    found = lambda patterns: " OR ".join("regexp_matches(t, '(?i)" + p.replace("'", "''") + "')" for p in patterns)
    cjk, ascii_ = "len(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]'))", "len(regexp_extract_all(t, '[A-Za-z]'))"
    flags = {
        "missing_rejected": "text IS NULL", "empty_rejected": "text IS NOT NULL AND t = ''", "no_cjk": f"t <> '' AND {cjk} = 0", "englishy": f"{ascii_} >= 25 AND {cjk} < 10", "meta_trace": found(P.META_TRACE),
        "xml_tags": found(P.TAGS), "quote_meta": f"contains(t, '\"') AND {ascii_} >= 10", "too_short": "t <> '' AND length(t) < 8",
    }
    cases = ", ".join(f"CASE WHEN {condition} THEN '{flag}' END" for flag, condition in flags.items())
    return f"SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT doc_id, text, coalesce({_S}, '') AS t FROM documents)"


@register("rejected_quality_flags", _flags_sql())
def rejected_quality_flags(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(P.rejected_quality_flags(F.col("text")), ",").alias("flags"))


@register("judge_pairs", f"""WITH {_ADJ} SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 3 = 0 THEN user_text WHEN turn % 3 = 1 THEN assistant_text ELSE user_text END AS chosen, CASE WHEN turn % 3 = 1 THEN user_text ELSE assistant_text END AS rejected, CASE turn % 3 WHEN 2 THEN 'retry' ELSE 'judge' END AS decided_by FROM adj""")
def judge_pairs(spark, sf):
    a = D.adjacent_pairs(V.turns(spark, sf))
    m = F.col("turn") % 3
    df = a.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("user_text").alias("a"), F.col("assistant_text").alias("b"), F.when(m == 0, "A").when(m == 1, '{"winner": "B"}').otherwise("??").alias("verdict"), F.lit("so:\nA").alias("retry"))
    return P.judge_pairs(df)


# --- reports


@register("label_distribution", f"""WITH {_DOCS}, j AS (SELECT concat_ws('|', coalesce(CAST(quality AS VARCHAR), 'null'), coalesce(CAST(toxic AS VARCHAR), 'null')) AS value, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, value LIMIT 12)
SELECT 'quality' AS label, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'joint', value, n FROM j""")
def label_distribution(spark, sf):
    return R.label_distribution(_docs(spark, sf), ["quality", "toxic"])


@register("dataset_stats", f"""WITH {_DOCS}, x AS (SELECT *, CASE WHEN quality IS NOT NULL THEN CAST(toxic = 1 AS DOUBLE) END AS f FROM d) SELECT 'source' AS facet, source AS value, count(*) AS n, avg(f) AS flag_ratio FROM x GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*), avg(f) FROM x GROUP BY 2""")
def dataset_stats(spark, sf):
    return R.dataset_stats(_docs(spark, sf), ["source", "lang"], F.col("toxic") == 1, F.col("quality").isNotNull())


@register("topic_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def topic_counts(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("length_summary", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, avg(n_chars) AS mean, max(n_chars) FILTER (i = n // 4) AS q1, max(n_chars) FILTER (i = n // 2) AS q2, max(n_chars) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY lang")
def length_summary(spark, sf):
    return R.length_summary(_docs(spark, sf), ["lang"], "n_chars")


@register("flag_report", f"""WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN length(text) < 100 THEN 'short' END], lambda x: x IS NOT NULL)) AS flag FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS r FROM f)
SELECT flag, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (r <= 3) AS examples FROM r GROUP BY flag""")
def flag_report(spark, sf):
    c = F.col("text")
    flags = F.array_compact(F.array(F.when(c.contains("@"), "email"), F.when(c.contains("|"), "table"), F.when(F.length(c) < 100, "short")))
    return R.flag_report(V.table(spark, sf, "documents").select("doc_id", flags.alias("flags")), "flags", "doc_id")


@register("sft_quality_report", f"""WITH t AS (SELECT role, {_S} AS t FROM conversations), p AS (SELECT substr(t, 1, 12) AS value, count(*) AS n FROM t WHERE role = 'assistant' AND t <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
SELECT 'messages' AS metric, role AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'role_leak', role, count(*) FROM t WHERE regexp_matches(t, 'the') GROUP BY 2 UNION ALL SELECT 'user_like', role, count(*) FROM t WHERE role = 'assistant' AND regexp_matches(t, '^(The|De)') GROUP BY 2 UNION ALL SELECT 'prefix', value, n FROM p""")
def sft_quality_report(spark, sf):
    return R.sft_quality_report(V.turns(spark, sf), "the", "^(The|De)")


@register("build_manifest", "SELECT 'config' AS metric, 'seed' AS key, '42' AS value UNION ALL SELECT 'rows', 'conversations', CAST(count(*) AS VARCHAR) FROM conversations UNION ALL SELECT 'rows', 'documents', CAST(count(*) AS VARCHAR) FROM documents")
def build_manifest(spark, sf):
    return R.build_manifest({"conversations": V.turns(spark, sf), "documents": _docs(spark, sf)}, {"seed": "42"})
