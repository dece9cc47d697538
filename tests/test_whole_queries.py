from pyspark.sql import functions as F

from dialoglake.operators import retrieval as R
from dialoglake.plans import catalog
from dialoglake.plans import views as V

SF = "/root/testdata/sf0.001"


def test_contents_are_whole(spark):
    q = catalog.queries()
    m = V.messages(spark, SF)
    whole = {r.message_id: r.content for r in m.where("content <> ''").select("message_id", "content").collect()}
    assert max(map(len, whole.values())) > 800
    assert {r.message_id: r.content for r in q["reassemble_messages"](spark, SF).collect()} == whole
    tail = m.where("role = 'user' and message_id % 9 <> 0").select(F.col("message_id").alias("id"), "content", F.when(F.col("user_id") % 2 == 0, "er").otherwise("que").alias("k"))
    late = {r.id for r in tail.where("instr(content, k) > 50").collect()}
    gone = {r.id for r in q["forget_matching"](spark, SF).where("status = 'deleted'").collect()}
    assert late and late <= gone


def test_workspace_has_metrics_and_triage(spark):
    got = catalog.queries()["conversation_workspace"](spark, SF).collect()
    n = {r.conversation_id: r["count"] for r in V.turn_metrics(spark, SF).groupBy("conversation_id").count().collect()}
    assert all(r.n_metrics == n.get(r.conversation_id, 0) for r in got)
    assert any(r.n_metrics > 0 for r in got) and any(r.status != "pending" for r in got)


def test_scopes_and_topics_are_whole(spark):
    q = catalog.queries()
    units = {r.unit_id for r in q["scope_fallback"](spark, SF).collect()}
    assert any(u // 1000 % 4 for u in units)
    spanish = [r.doc_id for r in q["balanced_topics"](spark, SF).where("lang = 'es'").collect()]
    assert any(i % 16 for i in spanish)
    hits = [(1, s, u) for s, us in (("user", [1, 2]), ("both", [1, 2, 3])) for u in us] + [(2, "user", 1), (2, "both", 1), (2, "both", 4), (3, "both", 5)]
    asked = spark.createDataFrame([(1, "user"), (2, "user"), (3, "user"), (4, "user")], "query_id int, role_scope string")
    got = R.scope_fallback(spark.createDataFrame(hits, "query_id int, role_scope string, unit_id int"), asked, 2)
    assert sorted((r.query_id, r.role_scope, r.unit_id) for r in got.collect()) == [(1, "user", 1), (1, "user", 2), (2, "both", 1), (2, "both", 4), (3, "both", 5)]
