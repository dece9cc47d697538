"""Profile facts of users: parsing, checking and applying proposed operations, limits and side effects of deletions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.functions import text as T


def parse_ops(raw: DataFrame) -> DataFrame:
    """(message_id, user_id, raw) with JSON {"operations": [..]} in the text -> one row per known operation."""
    schema = "struct<operations: array<struct<op: string, target_id: long, content: string>>>"
    p = raw.select("message_id", "user_id", F.posexplode(F.from_json(T.extract_json_text(F.col("raw")), schema)["operations"]).alias("op_no", "o"))
    return p.where(F.col("o.op").isin("add", "update", "delete")).select("message_id", "user_id", "op_no", "o.op", "o.target_id", "o.content")


def validate_ops(ops: DataFrame, profiles: DataFrame, most_chars: int = 64, most_tokens: int = 48) -> DataFrame:
    """Adds reason: why an operation can't be applied, null if it can."""
    active = profiles.where("status = 'active'").select("user_id", F.col("id").alias("target_id"), F.col("content").alias("now"))
    j = ops.join(active, ["user_id", "target_id"], "left")
    c = T.strip(T.text_of(F.col("content")))
    add, update, delete = (F.col("op") == k for k in ("add", "update", "delete"))
    reason = (
        F.when(add & F.col("target_id").isNotNull(), "add_has_target").when(~delete & (c == ""), "empty_content").when(~add & F.col("now").isNull(), "unknown_target").when(update & (T.norm_profile(F.col("content")) == T.norm_profile(F.col("now"))), "unchanged")
        .when(delete & (c != ""), "delete_has_content").when(F.length(c) > most_chars, "content_too_long").when(T.count_tokens(c) > most_tokens, "too_many_tokens")
    )
    return j.withColumn("reason", reason).drop("now")


def filter_ops(ops: DataFrame, profiles: DataFrame, most: int = 3, **limits) -> DataFrame:
    """The operations of a message that are applied: of its first `most`, those without a reason against them, the first for
    each target, with a content that no active profile and no applied operation before it has."""
    w = Window.partitionBy("message_id").orderBy("op_no")
    first = ops.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, most)).drop("r")
    good = validate_ops(first, profiles, **limits).where("reason is null").withColumn("key", T.norm_profile(F.col("content")))
    have = profiles.where("status = 'active'").select("user_id", T.norm_profile(F.col("content")).alias("key")).distinct()
    good = good.where("op = 'delete'").unionByName(good.where("op <> 'delete'").join(have, ["user_id", "key"], "left_anti").select(*good.columns))
    # One after another: an operation that is left out takes neither its target nor its content. A message has at most `most`.
    fields = F.struct("op_no", "op", "target_id", "content", "key")
    ops_of = good.groupBy("message_id", "user_id").agg(F.array_sort(F.collect_list(fields)).alias("ops"))
    start = F.struct(F.array().cast("array<bigint>").alias("targets"), F.array().cast("array<string>").alias("keys"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, o: Column) -> Column:
        adds = o["op"] != "delete"
        out = F.coalesce(F.array_contains(acc["targets"], o["target_id"]), F.lit(False)) | (adds & F.array_contains(acc["keys"], o["key"]))
        grown = lambda xs, x, when: F.when(~out & when, F.array_append(xs, x)).otherwise(xs)
        return F.struct(
            grown(acc["targets"], o["target_id"].cast("bigint"), o["target_id"].isNotNull()).alias("targets"), grown(acc["keys"], o["key"], adds).alias("keys"), grown(acc["kept"], o["op_no"].cast("int"), F.lit(True)).alias("kept")
        )

    kept = ops_of.withColumn("kept", F.aggregate("ops", start, step, lambda a: a["kept"]))
    one = kept.select("message_id", "user_id", F.explode(F.filter("ops", lambda o: F.array_contains(F.col("kept"), o["op_no"].cast("int")))).alias("o"))
    return one.select("message_id", "user_id", "o.op_no", "o.op", "o.target_id", "o.content")


_CJK = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")


def _tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return max(1, cjk + -(-(len(text) - cjk) // 3)) if text else 0


def _normal(text: str | None) -> str:
    out = " ".join((text or "").split())
    return out if not out or out[-1] in "。！？.!?" else out + "。"


class _Replay:
    """Active profiles of one user, {id: (created_at, content)}, through messages in order."""

    def __init__(self, most_items: int, most_tokens: int, most_ops: int, most_chars: int, item_tokens: int):
        self.limits = most_items, most_tokens
        self.of_op = most_ops, most_chars, item_tokens
        self.active: dict[int, tuple[int, str]] = {}

    def accepted(self, ops: list[dict]) -> list[tuple]:
        """(op_no, op, target, content) of those that hold, one after another, against what is active before the message."""
        most_ops, most_chars, item_tokens = self.of_op
        have = {_normal(c) for _, c in self.active.values()}
        out, touched, new = [], set(), set()
        for o in sorted(ops, key=lambda o: o["op_no"])[: max(1, most_ops)]:
            op, target, raw = o["op"], o["target_id"], (o["content"] or "").strip()
            if op not in ("add", "update", "delete") or (op == "add") != (target is None) or (op == "delete") != (raw == ""):
                continue
            if op != "add" and (target not in self.active or target in touched):
                continue
            content = _normal(raw)
            if op != "delete" and (len(raw) > most_chars or _tokens(raw) > item_tokens or content in have or content in new):
                continue
            if op != "delete":
                new.add(content)
            touched.add(target)
            out.append((o["op_no"], op, target, content))
        return out

    def apply(self, message_id: int, at: int, ops: list[dict]) -> list[tuple]:
        """Deletes, then updates, then adds, then the limits: rows (id, content, created_at, why) of what went."""
        good, gone = self.accepted(ops), []
        for _, op, target, _ in good:
            if op == "delete":
                created, content = self.active.pop(target)
                gone.append((target, content, created, "deleted"))
        for _, op, target, content in good:
            if op == "update":
                self.active[target] = (self.active[target][0], content)
        for no, op, _, content in good:
            if op == "add":
                self.active[message_id * 10 + no] = (at, content)
        return gone + self.pruned()

    def pruned(self) -> list[tuple]:
        gone = []
        order = sorted(self.active, key=lambda i: (self.active[i][0], i))
        block = "\n".join(f"- {self.active[i][1]}" for i in order)
        while order and (len(order) > self.limits[0] or _tokens(block) > self.limits[1]):
            first = order.pop(0)
            created, content = self.active.pop(first)
            gone.append((first, content, created, "pruned"))
            block = block.partition("\n")[2]
        return gone


def apply_ops(profiles: DataFrame, ops: DataFrame, messages: DataFrame, ledger: DataFrame | None = None, most_items: int = 20, most_tokens: int = 640, most_ops: int = 3, most_chars: int = 64, item_tokens: int = 48) -> DataFrame:
    """profiles (id, user_id, content, status, created_at) after the proposed operations (user_id, message_id, op_no, op,
    target_id, content) of all messages, each user's in order of message_id: id, user_id, content, status, created_at, why
    (deleted or pruned by this run, else null).

    Every message sees what those before it left: its first most_ops operations are checked against the facts active then,
    deletes come before updates before adds, and the limits hold again after it. An update keeps the time of creation. A
    message that is no live user message of the user changes nothing. A message in the ledger (user_id, message_id,
    content_hash) has been handled in this form: its operations are skipped, the limits are enforced all the same, so a
    batch that runs twice changes nothing; new_ledger_rows gives what to add to the ledger.

    The order of one user's messages can't be split, so a user is one stream: rows come sorted and only the active facts,
    which the limits bound, are held. Users are spread over tasks."""
    kind = F.struct(F.lit(0).alias("step"), F.col("id").alias("at"))
    none = F.lit(None).cast("array<struct<op_no: int, op: string, target_id: long, content: string>>")
    was = profiles.where("status = 'active'").select("user_id", kind.alias("place"), F.col("id").cast("long").alias("id"), "content", F.col("created_at").cast("long").alias("created_at"), none.alias("ops"))
    live = messages.where("role = 'user' and not is_deleted").select("user_id", "message_id", F.col("created_at").cast("long").alias("created_at"), F.sha2("content", 256).alias("content_hash"))
    if ledger is not None:
        done = ledger.select("user_id", "message_id", "content_hash", F.lit(True).alias("done")).distinct()
        live = live.join(done, ["user_id", "message_id", "content_hash"], "left")
    else:
        live = live.withColumn("done", F.lit(None).cast("boolean"))
    # A message has few operations; only the first most_ops of them count.
    w = Window.partitionBy("user_id", "message_id").orderBy("op_no")
    few = ops.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(1, most_ops))
    grouped = few.groupBy("user_id", "message_id").agg(F.collect_list(F.struct(F.col("op_no").cast("int").alias("op_no"), "op", F.col("target_id").cast("long").alias("target_id"), "content")).alias("ops"))
    events = live.join(grouped, ["user_id", "message_id"], "left")
    come = events.select("user_id", F.struct(F.lit(1).alias("step"), F.col("message_id").alias("at")).alias("place"), F.col("message_id").cast("long").alias("id"), F.lit(None).cast("string").alias("content"), "created_at", F.when(F.col("done").isNull(), F.col("ops")).alias("ops"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "user_id", "content", "status", "created_at", "why"]
        user, state, out = None, None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def left() -> list[tuple]:
            return [(i, user, c, "active", at, None) for i, (at, c) in state.active.items()] if state else []

        for b in batches:
            for u, step, i, content, at, todo in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or u != user:
                    out += left()
                    user, state = u, _Replay(most_items, most_tokens, most_ops, most_chars, item_tokens)
                if step == 0:
                    state.active[i] = (at, content)
                else:
                    out += [(g, u, c, "deleted", created, why) for g, c, created, why in state.apply(i, at, todo or [])]
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += left()
        if out:
            yield batch(out)

    stream = was.unionByName(come).repartition("user_id").sortWithinPartitions("user_id", "place").select(F.col("user_id").cast("long"), F.col("place.step").alias("step"), "id", "content", "created_at", "ops")
    after = stream.mapInArrow(run, "id long, user_id long, content string, status string, created_at long, why string")
    rest = profiles.where("status <> 'active' or status is null").select("id", "user_id", "content", "status", "created_at", F.lit(None).cast("string").alias("why"))
    return after.unionByName(rest)


def new_ledger_rows(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """What to add to the ledger after a batch: live user messages not handled in this form yet."""
    return maintenance_due(messages.where("role = 'user' and not is_deleted"), ledger)


def enforce_limits(profiles: DataFrame, most_items: int = 20, most_tokens: int = 640) -> DataFrame:
    """Of each user's active profiles the newest stay, as many as the limits allow; older ones become deleted. Tokens are those of
    the rendered list (- content, a line each), from running counts of characters, so no per-item rounding adds up."""
    w = Window.partitionBy("user_id", "status").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    line = F.concat(F.lit("- "), "content")
    cjk, n, count = F.sum(T.count_cjk(line)).over(w), F.sum(F.length(line) + 1).over(w) - 1, F.count(F.lit(1)).over(w)
    tokens = F.greatest(F.lit(1), cjk + F.ceil((n - cjk) / 3))
    over = (F.col("status") == "active") & ((count > most_items) | (tokens > most_tokens))
    return profiles.withColumn("status", F.when(over, "deleted").otherwise(F.col("status")))


def drop_orphans(profiles: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """Profiles that have sources (profile_id, message_id), none of them with a live unit, become deleted."""
    live = units.where("not is_deleted").select("message_id", F.lit(1).alias("alive")).distinct()
    g = sources.join(live, "message_id", "left").groupBy(F.col("profile_id").alias("id")).agg(F.max(F.coalesce("alive", F.lit(0))).alias("alive"))
    j = profiles.join(g, "id", "left")
    return j.withColumn("status", F.when(F.col("alive") == 0, "deleted").otherwise(F.col("status"))).select(*profiles.columns)


def forget_matching(profiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Active profiles whose content contains a keyword of their user (user_id, keyword), or is contained in one, become deleted."""
    r = requests.where("keyword <> ''").select(F.col("user_id").alias("__u"), "keyword")
    hit = profiles.where("status = 'active'").join(r, (F.col("user_id") == F.col("__u")) & (F.contains("content", "keyword") | F.contains("keyword", "content")), "left_semi").select("id", F.lit(True).alias("__hit"))
    return profiles.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), "deleted").otherwise(F.col("status"))).select(*profiles.columns)


def maintenance_due(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages not yet handled in this form: user_id, message_id, content_hash."""
    m = messages.select("user_id", "message_id", F.sha2("content", 256).alias("content_hash"))
    return m.join(ledger.select("user_id", "message_id", "content_hash"), ["user_id", "message_id", "content_hash"], "left_anti")


def render_profile(profiles: DataFrame) -> DataFrame:
    """Per user: the active facts, oldest first, escaped, a line each."""
    g = profiles.where("status = 'active'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", T.html_escape(F.col("content")).alias("c")))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda p: F.concat(F.lit("- "), p["c"])), "\n").alias("profile"))


def maintainer_payload(messages: DataFrame, profiles: DataFrame, most_items: int = 20, earlier: int = 8, earlier_tokens: int = 400, current_tokens: int = 1200) -> DataFrame:
    """For each user message, what a maintainer model is given, as JSON: free places, active profiles, the turns before, the text."""
    w = Window.partitionBy("conversation_id").orderBy("position").rowsBetween(-earlier, -1)
    before = T.truncate_by_tokens(F.array_join(F.collect_list(F.concat("role", F.lit(": "), "content")).over(w), "\n"), earlier_tokens)
    p = profiles.where("status = 'active'").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("items"))
    m = messages.withColumn("earlier", before).where("role = 'user'").join(p, "user_id", "left")
    payload = F.struct((most_items - F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0))).alias("capacity"), F.col("items").alias("profiles"), "earlier", T.truncate_by_tokens(F.col("content"), current_tokens).alias("current"))
    return m.select("message_id", "user_id", F.to_json(payload).alias("payload"))
