"""Dialogue assembly over turns (conv_id, turn, role, text): pairs, contexts, windows and picks.

Everything is a window inside a conversation, so one shuffle on conv_id serves a chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from dialoglake.functions import lexicons as X
from dialoglake.functions import text as T


def in_order() -> WindowSpec:
    """The turns of a conversation up to this one."""
    return Window.partitionBy("conv_id").orderBy("turn")


def canonical_turns(conversations: DataFrame) -> DataFrame:
    """Nested conversations (id, messages of role and content, or conversations of from and value) -> turns. Roles
    human and gpt become user and assistant; other roles and blank texts are dropped; messages win if both are there."""
    cols = set(conversations.columns)
    messages = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text"))) if "messages" in cols else F.lit(None)
    other = F.transform("conversations", lambda m: F.struct(m["from"].alias("role"), m["value"].alias("text"))) if "conversations" in cols else F.lit(None)
    picked = F.coalesce(messages, other) if cols >= {"messages", "conversations"} else messages if "messages" in cols else other
    role = lambda r: F.when(r.isin("human", "user"), "user").when(r.isin("gpt", "assistant"), "assistant")
    kept = F.filter(F.transform(picked, lambda m: F.struct(role(m["role"]).alias("role"), m["text"].alias("text"))), lambda m: m["role"].isNotNull() & (T.strip(T.text_of(m["text"])) != ""))
    return conversations.select(F.col("id").alias("conv_id"), F.posexplode(kept).alias("turn", "m")).select("conv_id", F.col("turn").cast("long"), "m.role", "m.text")


def to_sharegpt(turns: DataFrame) -> DataFrame:
    """turns -> (conv_id, conversations of from and value) for conversations whose kept turns end on the user."""
    who = F.when(F.col("role") == "user", "human").otherwise("gpt")
    kept = turns.where(F.col("role").isin("user", "assistant") & (T.strip(T.text_of(F.col("text"))) != ""))
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", who.alias("from"), F.col("text").alias("value")))).alias("m"))
    return rows.where(F.element_at("m", -1)["from"] == "human").select("conv_id", F.transform("m", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def read_alternating(lists: DataFrame) -> DataFrame:
    """(conv_id, texts): blanks are dropped first, then even places are the user's -> turns."""
    kept = F.filter("texts", lambda t: T.strip(T.text_of(t)) != "")
    return lists.select("conv_id", F.posexplode(kept).alias("turn", "text")).select("conv_id", F.col("turn").cast("long"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")


def pair_turns(turns: DataFrame) -> DataFrame:
    """User text and the assistant's answer: conv_id, pair_idx, user_turn, user_text, assistant_text. Empty texts don't
    count; of several user turns in a row the last is answered; only the first answer to a user turn counts."""
    t = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", T.norm_text(F.col("text")).alias("text")).where("text <> ''")
    p = t.select("*", *(F.lag(c).over(in_order()).alias(f"before_{c}") for c in ("role", "text", "turn"))).where("role = 'assistant' and before_role = 'user'")
    return p.select("conv_id", (F.row_number().over(in_order()) - 1).cast("long").alias("pair_idx"), F.col("before_turn").alias("user_turn"), F.col("before_text").alias("user_text"), F.col("text").alias("assistant_text"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """User turns directly followed by an assistant turn, texts as they are: conv_id, turn, user_text, assistant_text."""
    p = turns.select("*", F.lead("role").over(in_order()).alias("next_role"), F.lead("text").over(in_order()).alias("assistant_text"))
    return p.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "assistant_text")


def pair_context(pairs: DataFrame, max_pairs: int = 6) -> DataFrame:
    """Adds context (earlier pairs and the current user text as [USER]/[ASSISTANT] lines) and user_focus (the user
    texts of the same span), at most max_pairs pairs in all."""
    w = Window.partitionBy("conv_id").orderBy("pair_idx").rowsBetween(-(max_pairs - 1), -1)
    user = F.concat(F.lit("[USER] "), "user_text")
    lines = F.collect_list(F.concat(user, F.lit("\n[ASSISTANT] "), "assistant_text")).over(w)
    return pairs.select("*", F.array_join(F.concat(lines, F.array(user)), "\n").alias("context"), F.array_join(F.concat(F.collect_list("user_text").over(w), F.array("user_text")), "\n").alias("user_focus"))


def io_context(turns_io: DataFrame, max_pairs: int = 6) -> DataFrame:
    """(id, conversation of input and output) -> id, turn, context, user_focus. Unlike pair_context, user_focus holds
    all user texts so far, taken from the list of inputs that aren't empty and cut at the turn's number."""
    rows = turns_io.select("id", "conversation", F.posexplode("conversation").alias("turn", "io"))
    inputs = F.filter(F.transform("conversation", lambda x: T.norm_text(x["input"])), lambda x: x != "")
    earlier = F.slice("conversation", F.greatest(F.col("turn") - (max_pairs - 1), F.lit(0)) + 1, F.least(F.col("turn"), F.lit(max_pairs - 1)))
    lines = F.flatten(F.transform(earlier, lambda x: F.array(F.concat(F.lit("[USER] "), T.norm_text(x["input"])), F.concat(F.lit("[ASSISTANT] "), T.norm_text(x["output"])))))
    context = F.array_join(F.concat(lines, F.array(F.concat(F.lit("[USER] "), T.norm_text(F.col("io.input"))))), "\n")
    return rows.where(T.norm_text(F.col("io.input")) != "").select("id", "turn", context.alias("context"), F.array_join(F.slice(inputs, F.lit(1), F.col("turn") + 1), "\n").alias("user_focus"))


def instruction_reference(turns: DataFrame, max_turns: int, user_label: str = "用户：", assistant_label: str = "咨询师：") -> DataFrame:
    """One row per conversation: instruction (the dialogue from the pair max_turns back up to the last pair's user
    text, ending with the assistant's label) and reference (the last pair's answer); no row for an empty reference."""
    p = adjacent_pairs(turns.where(F.col("role").isin("user", "assistant")))
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    p = p.withColumn("back", F.row_number().over(last)).where(F.col("back") <= max_turns)
    line = F.when(F.col("back") == 1, F.concat(F.lit(user_label), "user_text")).otherwise(F.concat(F.lit(user_label), "user_text", F.lit("\n" + assistant_label), "assistant_text"))
    g = p.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"), F.max(F.when(F.col("back") == 1, F.col("assistant_text"))).alias("reference"))
    return g.where(T.strip(F.col("reference")) != "").select("conv_id", F.concat(F.array_join("x.line", "\n"), F.lit("\n" + assistant_label)).alias("instruction"), "reference")


def pick_end_user(turns: DataFrame, min_chars: int = 6, request: str = X.REQUEST, acks: list[str] = X.ACKS, closings: list[str] = X.CLOSINGS) -> DataFrame:
    """conv_id, end_turn: the last user turn that asks for something and says enough, else the last that says enough,
    else the last."""
    c = F.col("text")
    low = T.is_low_info(c, acks, min_chars) | T.is_closing(c, closings, request)
    rank = F.when(T.is_request(c, request) & ~low, 2).when(~low, 1).otherwise(0)
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("turn", F.struct(rank.alias("r"), "turn")).alias("end_turn"))


def tail_turns(turns: DataFrame, ends: DataFrame, max_turns: int) -> DataFrame:
    """Turns up to end_turn (conv_id, end_turn) that hold its last max_turns user turns (0: all); blank texts are left
    out, and what follows the last user turn too."""
    upto = turns.join(ends, "conv_id").where("turn <= end_turn")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = F.sum((F.col("role") == "user").cast("int"))
    kept = upto.withColumn("users", users.over(back.rowsBetween(Window.unboundedPreceding, -1)))
    if max_turns > 0:
        kept = kept.where(F.coalesce("users", F.lit(0)) < max_turns)
    kept = kept.where(T.strip(T.text_of(F.col("text"))) != "")
    seen = F.max((F.col("role") == "user").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("seen", seen).where("seen = 1").select("conv_id", "turn", "role", "text")


def prompt_pool(turns: DataFrame, max_turns: int = 4, min_chars: int = 6, user_only: bool = False, redact: bool = False, require_request: bool = False, **lists) -> DataFrame:
    """One prompt per conversation, ending on the picked user turn: conv_id, n_messages, prompt (role: text lines)."""
    ends = pick_end_user(turns, min_chars, **lists)
    if require_request:
        ends = ends.join(turns.where(T.is_request(F.col("text"), lists.get("request", X.REQUEST))).select("conv_id", F.col("turn").alias("end_turn")), ["conv_id", "end_turn"], "left_semi")
    tail = tail_turns(turns, ends, max_turns)
    if user_only:
        tail = tail.where("role = 'user'")
    text = T.redact_pii(F.col("text")) if redact else F.col("text")
    g = tail.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), text).alias("line")))).alias("x"))
    return g.select("conv_id", F.size("x").cast("long").alias("n_messages"), F.array_join("x.line", "\n").alias("prompt"))


def user_windows(turns: DataFrame, ok: Column, sizes: tuple[int, ...] = (1, 2, 3), most_each: int = 2, seed: str = "42", min_chars: int = 8) -> DataFrame:
    """Windows of neighbouring user turns that are all ok (a condition on text), at most most_each per conversation and size, taken by seeded hash: conv_id,
    n_turns, start, text, chars."""
    u = turns.where("role = 'user'").select("conv_id", "turn", T.norm_text(F.col("text")).alias("text"), ok.alias("ok"))
    out = None
    for k in sizes:
        w = in_order().rowsBetween(0, k - 1)
        part = u.select("conv_id", F.lit(k).alias("n_turns"), F.col("turn").alias("start"), F.collect_list("text").over(w).alias("x"), F.min("ok").over(w).alias("all_ok")).where((F.size("x") == k) & F.col("all_ok"))
        part = part.select("conv_id", "n_turns", "start", F.array_join("x", "\n").alias("text"))
        out = part if out is None else out.unionByName(part)
    pick = Window.partitionBy("conv_id", "n_turns").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "conv_id", "n_turns", "start")), "start")
    kept = out.where(F.length("text") >= min_chars).withColumn("r", F.row_number().over(pick)).where(F.col("r") <= most_each)
    return kept.select("conv_id", "n_turns", "start", "text", F.length("text").cast("long").alias("chars"))


def classifier_window(turns: DataFrame, n: int = 3, prefix: str = "[USER] ") -> DataFrame:
    """At each user turn, its and the n - 1 user texts before it: conv_id, turn, window."""
    u = turns.where((F.col("role") == "user") & (T.strip(T.text_of(F.col("text"))) != "")).withColumn("line", F.concat(F.lit(prefix), T.strip(F.col("text"))))
    return u.select("conv_id", "turn", F.array_join(F.collect_list("line").over(in_order().rowsBetween(-(n - 1), 0)), "\n").alias("window"))


def pick_best_utterance(turns: DataFrame, good: Column) -> DataFrame:
    """The best good text of a conversation, longer ones and those with a question or full stop first, the later of
    equals; with the text before it if that is good: conv_id, turn, sample."""
    t = turns.select("conv_id", "turn", T.norm_text(F.col("text")).alias("text"), good.alias("good"))
    score = F.length("text") + F.when(F.col("text").rlike("[？?]"), 3).otherwise(0) + F.when(F.col("text").contains("。"), 2).otherwise(0)
    t = t.withColumns({"before": F.when(F.lag("good").over(in_order()), F.lag("text").over(in_order())), "score": score})
    best = t.where("good").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text", "before"), F.struct("score", "turn")).alias("b"))
    sample = F.when(F.col("b.before").isNotNull(), F.concat(F.lit("上文："), "b.before", F.lit("\n用户："), "b.text")).otherwise(F.col("b.text"))
    return best.select("conv_id", "b.turn", sample.alias("sample"))


def to_dialogue_text(raw: Column, filler: str = "我在，慢慢说。") -> Column:
    """A bare text, or one of two parts (上文/用户, or question/补充), as role-tagged turns with a filler answer between."""
    t = T.strip(T.text_of(raw))

    def two(first: Column, second: Column) -> Column:
        a, b = T.strip(first), T.strip(second)
        return F.when((a != "") & (b != ""), F.concat(F.lit("[USER] "), a, F.lit(f"\n[ASSISTANT] {filler}\n[USER] "), b)).otherwise(F.concat(F.lit("[USER] "), F.when(a != "", a).otherwise(b)))

    said = F.split(t, "\n用户：", 2)
    more = F.split(t, "\n补充：", 2)
    return F.when(t == "", t).when(t.startswith("上文：") & t.contains("\n用户："), two(F.regexp_replace(F.get(said, F.lit(0)), "^上文：", ""), F.get(said, F.lit(1)))).when(t.contains("\n补充："), two(F.get(more, F.lit(0)), F.get(more, F.lit(1)))).otherwise(F.concat(F.lit("[USER] "), t))


def select_timepoints(pairs: DataFrame, total: int = 3, seed: str = "42") -> DataFrame:
    """Pairs of a conversation to sample: the last, the middle one, and others by seeded hash up to `total`."""
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    p = pairs.withColumn("n_pairs", n)
    first = F.when(F.col("pair_idx") == F.col("n_pairs") - 1, 0).when(F.col("pair_idx") == F.floor(F.col("n_pairs") / 2), 1).otherwise(2)
    w = Window.partitionBy("conv_id").orderBy("first", F.md5(F.concat_ws("|", F.lit(seed), "conv_id", "pair_idx")), "pair_idx")
    return p.withColumn("first", first).withColumn("r", F.row_number().over(w)).where(F.col("r") <= total).drop("first", "r", "n_pairs")


def prompt_prefix(turns: DataFrame, max_msgs: int = 8, max_prompt: int = 1200, max_chosen: int = 800, max_total: int = 1800) -> DataFrame:
    """For every adjacent pair: the last max_msgs messages up to its user turn, with the answer as chosen; pairs over a
    character cap are dropped: conv_id, turn, prompt, prompt_chars, chosen."""
    t = turns.where(F.col("role").isin("user", "assistant"))
    line = F.concat("role", F.lit(": "), T.strip(F.col("text")))
    w = in_order().rowsBetween(-(max_msgs - 1), 0)
    p = t.select("conv_id", "turn", "role", F.collect_list(line).over(w).alias("lines"), F.lead("role").over(in_order()).alias("next_role"), T.strip(F.lead("text").over(in_order())).alias("chosen"))
    p = p.where("role = 'user' and next_role = 'assistant'").withColumn("prompt", F.array_join("lines", "\n")).withColumn("prompt_chars", F.length("prompt").cast("long"))
    return p.where((F.col("prompt_chars") <= max_prompt) & (F.length("chosen") <= max_chosen) & (F.col("prompt_chars") + F.length("chosen") <= max_total)).select("conv_id", "turn", "prompt", "prompt_chars", "chosen")


def format_dialog(turns: DataFrame, labels: dict[str, str], max_msgs: int = 6, max_chars: int = 600) -> DataFrame:
    """The last max_msgs labelled messages of a conversation, and of those the last max_chars characters."""
    t = turns.where(F.col("role").isin(list(labels)))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    label = F.coalesce(*(F.when(F.col("role") == r, v) for r, v in labels.items()))
    t = t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_msgs)
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(label, T.strip(F.col("text"))).alias("line")))).alias("x"))
    d = F.array_join("x.line", "\n")
    return g.select("conv_id", F.when(F.length(d) > max_chars, F.substring(d, F.length(d) - max_chars + 1, F.lit(max_chars))).otherwise(d).alias("dialog"))


def recent_window(turns: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation, and of those the turns of user and assistant; blank assistant texts don't count."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
    return last.where((F.col("role") == "user") | ((F.col("role") == "assistant") & (T.strip(T.text_of(F.col("text"))) != "")))


def since_watermark(turns: DataFrame, marks: DataFrame) -> DataFrame:
    """Turns after the last summarised one (conv_id, last_turn); all of them where there is no mark."""
    return turns.join(marks, "conv_id", "left").where(F.col("last_turn").isNull() | (F.col("turn") > F.col("last_turn"))).drop("last_turn")


def assign_turns(turns: DataFrame) -> DataFrame:
    """Adds position (1-based), turn_id (the user message that opened the exchange; an assistant before any opens its
    own) and reply_to (that user message, for assistant messages; null if there is none)."""
    opened = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    t = turns.select("*", F.row_number().over(in_order()).cast("long").alias("position"), opened.alias("opened"))
    return t.withColumns({"turn_id": F.coalesce("opened", "turn"), "reply_to": F.when(F.col("role") == "assistant", F.col("opened"))}).drop("opened")


def conversation_score(turns: DataFrame, lexicon: list[str], min_messages: int = 6, min_user: int = 3, min_chars: int = 150, min_signals: int = 2) -> DataFrame:
    """Conversations that are long and telling enough: conv_id, n_messages, user_turns, user_chars, signals (terms of
    the lexicon that the user texts hold), score = 100 * signals + user_chars."""
    user = F.when(F.col("role") == "user", T.text_of(F.col("text")))
    terms = [F.max(user.contains(t).cast("int")) for t in lexicon]
    g = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count(user).alias("user_turns"), F.sum(F.length(user)).alias("user_chars"), *(F.coalesce(x, F.lit(0)).alias(f"t{k}") for k, x in enumerate(terms)))
    g = g.withColumn("signals", sum((F.col(f"t{k}") for k in range(len(lexicon))), F.lit(0)).cast("long"))
    g = g.where((F.col("n_messages") >= min_messages) & (F.col("user_turns") >= min_user) & (F.col("user_chars") >= min_chars) & (F.col("signals") >= min_signals))
    return g.select("conv_id", "n_messages", "user_turns", "user_chars", "signals", (100 * F.col("signals") + F.col("user_chars")).alias("score"))
