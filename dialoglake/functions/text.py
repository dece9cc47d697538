"""Text measures and clean-ups as column expressions of built-in functions; the dataset-level jobs in operators use
them. Null text counts as empty wherever the reference reads an absent value."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"[\x{4e00}-\x{9fff}]"
CJK_EXTENDED = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Python's strip: all white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """Stripped, without blanks, zero-width spaces and byte-order marks."""
    return strip(F.regexp_replace(strip(text_of(c)), r"[ \x{200b}\x{feff}]", ""))


def norm_key(c: Column) -> Column:
    """Lower case without any white space: what counts as the same text."""
    return F.lower(F.regexp_replace(text_of(c), r"(?U)\s+", ""))


def count_cjk(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(CJK))


def count_ascii_letters(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit("[A-Za-z]"))


def at_least(kind: str, n: int) -> str:
    """A pattern that finds n characters of a class, with anything between."""
    return f"(?:{kind}[^{kind[1:-1]}]*+){{{n}}}"


def folded(c: Column) -> Column:
    """Lower case as a pattern's (?iu) sees it: also the four other characters that it takes for an ASCII letter."""
    return F.lower(F.translate(c, "\u017f\u0131\u0130\u212a", "siik"))


def _alternatives(pattern: str) -> list[str]:
    """A pattern's parts between the | that stand in no group or class."""
    parts, depth = [""], 0
    for x in re.findall(r"\\.|.", pattern, re.S):
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if x == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += x
    return parts


def matches_any(c: Column, low: Column, patterns: list[str]) -> Column:
    """Whether any of these patterns is in the text, in any case; low is the text folded. What is a plain term is looked for in
    the folded text, which costs far less than a search for many terms in any case; only the rest is a pattern."""
    plain, rest = [], []
    for part in (a for p in patterns for a in _alternatives(p)):
        term, marks = re.sub(r"\\(\W)", r"\1", part), re.sub(r"\\\W", "", part)
        is_plain = term and not re.search(r"[\\^$.|?*+()\[\]{}]", marks) and all(x.isascii() or x.lower() == x.upper() for x in term)
        (plain if is_plain else rest).append(term.lower() if is_plain else part)
    tests = [low.contains(x) for x in plain] + ([c.rlike("(?iu)" + "|".join(f"(?:{p})" for p in rest))] if rest else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def one_of(terms: list[str]) -> str:
    """A pattern that matches any of these literal terms; never matches for no terms."""
    quoted = ["".join("\\" + x if x in r"\.[]{}()*+?^$|-#&~" else x for x in t) for t in terms]
    return "(?:" + "|".join(quoted) + ")" if terms else "(?!)"


def contains_any(c: Column, terms: list[str]) -> Column:
    return c.rlike(one_of(terms))


def first_label(c: Column, lists: dict[str, list[str]], otherwise: str) -> Column:
    """The label of the first list with a term in the text."""
    return reduce(lambda out, kv: F.when(contains_any(c, kv[1]), kv[0]).otherwise(out), reversed(lists.items()), F.lit(otherwise))


def count_tokens(c: Column) -> Column:
    """0 for empty text, else at least 1: a token per CJK character (extension A included) and per three others."""
    cjk = F.regexp_count(text_of(c), F.lit(CJK_EXTENDED))
    n = F.length(text_of(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), cjk + F.ceil((n - cjk) / 3))).cast("long")


def estimate_tokens(c: Column) -> Column:
    """The other estimate, of length / 1.5, used for evidence lines."""
    return F.greatest(F.lit(1), F.floor(F.length(text_of(c)) / 1.5)).cast("long")


def truncate_by_tokens(c: Column, most: int, head_ratio: float = 0.6, step: int = 8) -> Column:
    """The text if it has at most `most` tokens; else head + … + tail, taken from ever fewer characters (step fewer at
    a time, starting at most characters) until it fits."""
    text = text_of(c)
    sizes = F.sequence(F.lit(max(most, 1)), F.lit(1), F.lit(-step)) if most > step else F.array(F.lit(max(most, 1)))
    cut = lambda n: F.concat(F.substring(text, F.lit(1), F.floor(n * head_ratio).cast("int")), F.lit("…"), F.when(n - F.floor(n * head_ratio) > 0, F.substring(text, F.length(text) - (n - F.floor(n * head_ratio)).cast("int") + 1, (n - F.floor(n * head_ratio)).cast("int"))).otherwise(""))
    fits = F.filter(F.transform(sizes, cut), lambda t: count_tokens(t) <= most)
    return F.when(count_tokens(text) <= most, text).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit("")))


def clean_reply(c: Column, openers: list[str] = ()) -> Column:
    """Without forum openers at the start, emoji and runs of blanks."""
    out = strip(text_of(c))
    if openers:
        out = F.regexp_replace(out, "^(?:" + "|".join(one_of([o]) for o in openers) + r")[\s,，。!！:：~]*", "")
    out = F.regexp_replace(out, r"[\x{1F300}-\x{1FAFF}]", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


# What counts as an e-mail address, a phone number and an id number, and what stands for them.
PII = {
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}": "[REDACTED_EMAIL]",
    r"(?<!\d)(?:1\d{10}|(?:\+?\d{1,3}[- ]?)?\d{3,4}[- ]?\d{7,8})(?!\d)": "[REDACTED_PHONE]",
    r"(?<!\d)\d{17}[\dXx](?!\d)": "[REDACTED_ID]",
}


def redact_pii(c: Column) -> Column:
    """E-mail addresses, phone numbers and 18-character id numbers, in that order."""
    return reduce(lambda out, kv: F.regexp_replace(out, kv[0], kv[1]), PII.items(), text_of(c))


def sentences(c: Column) -> Column:
    """Split after sentence marks and line breaks; blank pieces don't count."""
    return F.filter(F.split(text_of(c), r"(?<=[。！？!?\n])"), lambda s: strip(s) != "")


def first_sentence(c: Column, least: int = 30, most: int = 120) -> Column:
    """Sentences from the start until they have `least` characters, however long the last; the first `most` characters
    if there is no sentence."""
    t = strip(text_of(c))
    got = strip(F.aggregate(sentences(t), F.lit(""), lambda acc, s: F.when(F.length(acc) >= least, acc).otherwise(F.concat(acc, s))))
    return F.when(got == "", strip(F.substring(t, 1, most))).otherwise(got)


_PUNCTUATION = r"""[,.!?;:"'()\[\]{}，。！？；：、“”‘’（）【】《》…~～\-]"""


def norm_answer(c: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(norm_key(c), _PUNCTUATION, "")


def norm_profile(c: Column, stop: str = "。") -> Column:
    """White space collapsed, with a final stop."""
    out = strip(F.regexp_replace(text_of(c), r"(?U)\s+", " "))
    return F.when(out == "", "").when(out.rlike(r"[。！？.!?]$"), out).otherwise(F.concat(out, F.lit(stop)))


def words(c: Column) -> Column:
    """Distinct lower-cased Latin words and digits, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit(r"[a-z0-9]+"), F.lit(0)))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items, joined by a blank; empty for fewer."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(0), F.size(items) - n), lambda i: F.array_join(F.slice(items, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int) -> Column:
    """All runs of n characters; empty for fewer. Zips shifted copies of the split text: a lambda that looked into the
    text would scan it again for every place."""
    chars = F.split(c, "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.length(c), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_compact(out)


def char_bigrams(c: Column) -> Column:
    return F.array_distinct(char_ngrams(norm_key(c), 2))


# Fixed value: what counts as an entity.
ENTITY = r"[\x{4e00}-\x{9fff}]{2,6}|[A-Za-z][A-Za-z0-9_\-]+|\d{1,4}(?:\.\d+)?(?:度|分|周|天|年|月|日)?"


def entity_set(c: Column, pattern: str = ENTITY) -> Column:
    """Distinct entities, in order of appearance: short CJK runs, Latin names, numbers with their unit."""
    return F.array_distinct(F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths or a zero norm; in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def searchable_text(role: Column, content: Column, labels: dict[str, str]) -> Column:
    label = reduce(lambda out, kv: F.when(role == kv[0], kv[1]).otherwise(out), labels.items(), role)
    return F.concat(label, F.lit("\n"), text_of(content))


def snippet(c: Column, n: int) -> Column:
    """One line of at most n characters, … included where it was cut."""
    line = strip(F.replace(text_of(c), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n - 1), F.lit("…")))


def truncate_chars(c: Column, n: int) -> Column:
    """The text, or its first n characters with … in place of the last where it is longer."""
    t = text_of(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def auto_title(c: Column, n: int = 20) -> Column:
    """The first n characters on one line, and … after them where there are more."""
    line = strip(F.replace(text_of(c), F.lit("\n"), F.lit(" ")))
    return F.concat(F.substring(line, 1, n), F.when(F.length(line) > n, "…").otherwise(""))


def html_escape(c: Column) -> Column:
    out = text_of(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def date_label(epoch: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), "yyyy-MM-dd")


def parse_session_date(c: Column) -> Column:
    """`2024/03/05 (Tue) 08:30` as a timestamp in UTC; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(c, r"\s*\(\w+\)\s*", " "), F.lit("yyyy/MM/dd HH:mm"))


def user_hash(c: Column) -> Column:
    return F.when(c.isNull(), "anon").otherwise(F.concat(F.lit("u_"), F.substring(F.sha2(c.cast("string"), 256), 1, 8)))


def stable_pick(seed: Column, options: list[str]) -> Column:
    """The same option for the same seed; by crc32."""
    return F.element_at(F.array(*(F.lit(o) for o in options)), (F.crc32(seed.cast("binary")) % len(options)).cast("int") + 1)


def distinct_share(c: Column) -> Column:
    return F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1))


def is_meaningful_utterance(c: Column, blocked: list[str], least: int = 10, most: int = 160, needs: str = CJK, least_distinct: float = 0.15, most_other: float = 0.6) -> Column:
    """Daily chat worth keeping: of some length, in the expected script, varied, without blocked terms."""
    t = norm_text(c)
    n = F.length(t)
    return n.between(least, most) & t.rlike(needs) & ~contains_any(t, blocked) & (distinct_share(t) >= least_distinct) & ((n - F.regexp_count(t, F.lit(needs))) / F.greatest(n, F.lit(1)) <= most_other)


def is_ok_user_utterance(c: Column, blocked: list[str], least: int = 4, most: int = 400, needs: str = CJK, least_distinct: float = 0.12) -> Column:
    t = norm_text(c)
    return F.length(t).between(least, most) & t.rlike(needs) & (distinct_share(t) >= least_distinct) & ~contains_any(t, blocked)


def is_request(c: Column, pattern: str) -> Column:
    return text_of(c).rlike(pattern)


def is_closing(c: Column, closings: list[str], request: str) -> Column:
    """Thanks and farewells, unless there is a request as well."""
    return contains_any(norm_key(c), closings) & ~is_request(c, request)


def is_low_info(c: Column, acks: list[str], least: int) -> Column:
    t = norm_key(c)
    return (F.length(t) < least) | t.isin(acks)


def extract_json_text(c: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0), F.lit(""))


def extract_choice(c: Column) -> Column:
    """The first letter A to E that stands alone in the upper-cased text, else a leading one, else null."""
    t = F.upper(strip(text_of(c)))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(?:^|[^A-Z])([A-E])(?:[^A-Z]|$)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^([A-E])", 1), F.lit("")))


@F.pandas_udf(T.DoubleType())
def repeated_share(c: pd.Series) -> pd.Series:
    """Share of the runs of three characters that repeat an earlier one; 0 for fewer than 12 characters."""

    def share(t: str | None) -> float:
        if t is None or len(t) < 12:
            return 0.0
        x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        grams = x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]
        return 1 - len(np.unique(grams)) / len(grams)

    return c.map(share)


def repetition_score(c: Column) -> Column:
    """Longer is better up to 400 characters; questions and repeated 3-grams of characters (white space apart) cost."""
    t = strip(text_of(c))
    n = F.length(t)
    repeated = repeated_share(F.regexp_replace(t, r"(?U)\s+", ""))
    score = F.least(n, F.lit(400)) / 400.0 - 0.06 * F.least(F.regexp_count(t, F.lit("[?？]")), F.lit(6)) - 1.2 * F.least(repeated, F.lit(0.4))
    return F.when(n == 0, -1e9).otherwise(score)


def safe_int_label(c: Column) -> Column:
    """Digits, true and false as an int; anything else is an error."""
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin("true", "1.0"), 1).when(t.isin("false", "0.0"), 0).when(t.rlike(r"^-?\d+$"), t.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(t, F.lit("null")))).cast("int"))


def strip_quotes(c: Column, pairs: tuple[tuple[str, str], ...] = (('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"), ("「", "」"), ("『", "』"), ("《", "》"))) -> Column:
    """Without the first pair of quotes that encloses the whole text."""
    t = strip(text_of(c))
    inner = F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    return reduce(lambda out, p: F.when((F.length(t) >= 2) & t.startswith(p[0]) & t.endswith(p[1]), strip(inner)).otherwise(out), reversed(pairs), t)


def strip_think(c: Column) -> Column:
    """Without closed thinking blocks, and without an unclosed one to the end."""
    return strip(F.regexp_replace(F.regexp_replace(text_of(c), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def match_snippet(text: Column, chunk: Column, limit: int) -> Column:
    """max(64, limit) characters of the text around the chunk, … where it was cut; the start if it isn't there."""
    size = max(64, limit)
    n, at = F.length(text), F.position(chunk, text)
    begin = F.greatest(F.lit(1), F.least(at - F.floor((size - F.length(chunk)) / 2).cast("int"), n - size + 1))
    begin = F.when(at == 0, F.lit(1)).otherwise(begin)
    body = F.substring(text, begin, F.lit(size))
    return F.when(n <= size, text).otherwise(F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(begin + size <= n, "…").otherwise("")))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the column, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def postprocess_candidate(c: Column) -> Column:
    """The answer in a generated text that talks about it. If it announces an example: from its first double quote on,
    without quotes around it (if that leaves anything), and of that the last line that isn't blank. Then without a
    leading account of thoughts up to the word for answer, without that word as a label, without a list mark, and
    without quotes around it."""

    def example(t: Column) -> Column:
        at = F.position(F.lit('"'), t)
        quoted = F.when(at > 0, bound(strip(F.substring(t, at, F.length(t))), lambda q: strip_quotes(q))).otherwise("")
        found = bound(quoted, lambda q: F.when(q != "", q).otherwise(t))
        return bound(F.filter(F.transform(F.split(found, r"\R"), strip), lambda x: x != ""), lambda lines: F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(t))

    out = bound(strip(text_of(c)), lambda t: F.when(contains_any(t, EXAMPLE), example(t)).otherwise(t))
    for pattern in THOUGHTS:
        out = F.regexp_replace(out, pattern, "")
    return strip(bound(out, lambda t: strip_quotes(t)))


# What announces an example, and what is cut from the start of a candidate.
EXAMPLE = ["比如", "例如", "示例"]
THOUGHTS = [r"(?s)\A(?:分析|思考|思路|思考过程).*?(?:回复|回答|建议)[：:]", r"\A\s*(?:回复|回答|建议)\s*[:：]\s*", r"\A\s*[-•]\s*"]
