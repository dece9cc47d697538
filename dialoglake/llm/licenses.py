"""Operator 10, license scans by an exact set-similarity join, with built-in functions only.

A text block is a run of words within a paragraph (line breaks don't end it), for each template as long as the template
/ `threshold`. A block matches a template if it contains at least `threshold` of the template's distinct words. Of
templates that share `threshold` of the words of the shorter one, only the one contained best counts in a paragraph
(ties: the one of more words), so a notice isn't taken for its relatives as well.

The join is exact. Template words are ordered by how many texts of the corpus hold them, rarest first. Paragraphs are
read in overlapping windows that suit the longest template; a window goes on only if it holds one of the first
|T| - need + 1 words of a template (prefix filter), has at least `need` of all templates' words (length filter), and
what is left of the template from the first common word on suffices (positional filter). Survivors are verified by
counting in every run of the window. Words that no template has can't change an overlap; paragraphs of a text are kept
only if the whole text has `need` words of some template. Texts are read once and never shuffled.

Templates and their labels are few and fixed, so their table may be broadcast; it doesn't grow with the corpus.

Defined results: null text is the empty text and gives zero words, no labels and score 0; repeated rows and repeated
or null ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialoglake.llm.common import freeze

# Phrases that mark a license by themselves.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The wording of common license statements and notices.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "licensed under the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "licensed under the gnu lesser general public license": "lgpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}
THRESHOLD = 0.8
PARAGRAPH = r"\n[ \t\r]*\n"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    """Lower case, for comparing with words of ASCII letters. Of the letters beyond ASCII, two have ASCII in their lower
    case (the Kelvin sign and the dotted capital I); they become other letters first, so that only A-Z do."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def _spaced(text: Column) -> Column:
    """Words of a-z, 0-9 and beyond ASCII of a lower-case text, each with a blank of its own on either side."""
    trimmed = F.trim(F.regexp_replace(text, _GAP, " "))
    return F.when(trimmed == "", "").otherwise(F.concat(F.lit(" "), F.replace(trimmed, F.lit(" "), F.lit("  ")), F.lit(" ")))


def _count(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("long")


def _places(phrase: str) -> tuple[Column, Column, Column]:
    """How often the phrase stands in `spaced`, and the numbers of its first and last start (null if nowhere)."""
    p, s = " " + phrase.replace(" ", "  ") + " ", F.col("spaced")
    there = F.contains(s, F.lit(p))
    before = F.substring(s, F.lit(1), F.instr(s, p) - 1)
    back = F.instr(F.reverse(s), p[::-1])
    before_last = F.substring(s, F.lit(1), F.length(s) - back + 1 - F.lit(len(p)))
    return F.when(there, _count(s, p)).otherwise(F.lit(0).cast("long")), F.when(there, (_count(before, " ") / 2).cast("long")), F.when(there, (_count(before_last, " ") / 2).cast("long"))


def _template_words(template: str) -> list[str]:
    return sorted(set(template.split()))


def _need(template: str, threshold: float) -> int:
    return ceil(round(threshold * len(_template_words(template)), 9))


def _longest_run(template: str, threshold: float) -> int:
    return ceil(round(len(template.split()) / threshold, 9))


def _near(a: str, b: str, threshold: float) -> bool:
    """Whether two templates share `threshold` of the words of the shorter one."""
    x, y = set(a.split()), set(b.split())
    return a != b and len(x & y) >= round(threshold * min(len(x), len(y)), 9)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels
    (with those of matching templates), score (1 for a phrase, else the best containment that reached the threshold)."""
    spark = docs.sparkSession
    names = list(templates)
    words, need = [_template_words(t) for t in names], [_need(t, threshold) for t in names]
    strings = lambda ws: F.array(*(F.lit(w) for w in ws))
    vocabulary = strings(sorted({w for ws in words for w in ws}))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "text", _spaced(F.col("text")).alias("spaced"))
    rows = rows.withColumn("held", F.array_intersect(vocabulary, F.split(F.trim("spaced"), "  ")))
    found = {p: _places(p) for p in phrases}
    possible = reduce(lambda a, b: a | b, (F.size(F.array_intersect("held", strings(w))) >= n for w, n in zip(words, need)))
    base = freeze(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.when(F.col("spaced") == "", F.lit(0).cast("long")).otherwise((_count(F.col("spaced"), " ") / 2).cast("long")).alias("n_words"),
            reduce(lambda a, b: a + b, (n for n, _, _ in found.values())).alias("n_base"),
            _lowest(F.least, [first for _, first, _ in found.values()]).alias("first_word"),
            _lowest(F.greatest, [last for _, _, last in found.values()]).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(n > 0, F.lit(phrases[p])) for p, (n, _, _) in found.items()))))).alias("base"),
            "held",
            F.when(possible, F.split("text", PARAGRAPH)).alias("paragraphs"),
        ),
        "license-rows",
    )
    # Windows of twice the length at every length: whatever is as long lies in one of them.
    length = max(_longest_run(t, threshold) for t in names)
    paragraph = base.where("paragraphs is not null").select("row", F.posexplode("paragraphs").alias("para", "text"))
    paragraph = paragraph.select("row", "para", F.array_remove(F.split(F.regexp_replace("text", _GAP, " "), " "), "").alias("w")).where(F.size("w") >= min(need))
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / length).cast("int"))
    masked = lambda w: F.transform(w, lambda x: F.when(F.array_contains(vocabulary, x), x).otherwise(""))
    block = paragraph.select("row", "para", F.posexplode(F.transform(starts, lambda k: F.slice("w", k * length + 1, 2 * length))).alias("block", "run"))
    block = block.select("row", "para", "block", masked(F.col("run")).alias("run"))
    block = block.withColumn("words", F.array_remove(F.array_distinct("run"), "")).where(F.size("words") >= min(need))
    ranked = spark.createDataFrame(
        [(k, templates[t], w, need[k], len(words[k]), _longest_run(t, threshold)) for k, t in enumerate(names) for w in words[k]], "template int, label string, word string, need int, size int, long int"
    )
    often = base.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    order = freeze(ranked.join(often, "word", "left").fillna(0, ["df"]), "license-order")
    # Order of words within a template, rarest first.
    placed = order.withColumn("pos", F.row_number().over(Window.partitionBy("template").orderBy("df", "word")))
    prefix = placed.where(F.col("pos") <= F.col("size") - F.col("need") + 1).select("template", "word", "pos")
    wanted = placed.groupBy("template", "label", "need", "size", "long").agg(F.collect_set("word").alias("wanted"))
    token = block.select("*", F.explode("words").alias("word")).join(F.broadcast(prefix), "word")
    # The first prefix word a block shares with the template decides what is left of the template.
    met = token.groupBy("row", "para", "block", "template").agg(F.min("pos").alias("first"), F.first("words").alias("words"), F.first("run").alias("run"))
    met = met.join(F.broadcast(wanted), "template").where((F.size("words") >= F.col("need")) & (F.col("size") - F.col("first") + 1 >= F.col("need")))
    met = met.where(F.size(F.array_intersect("words", "wanted")) >= F.col("need"))
    ends = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("run") - F.col("long")))
    met = met.withColumn("overlap", F.array_max(F.transform(ends, lambda i: F.size(F.array_intersect(F.slice("run", i + 1, F.col("long")), "wanted"))))).where("overlap >= need")
    best = met.groupBy("row", "para", "template", "label", "size").agg(F.max(F.col("overlap") / F.col("size")).alias("share"))
    # At most one entry a template.
    of_para = best.groupBy("row", "para").agg(F.collect_list(F.struct("template", "label", "share", "size")).alias("all"))
    relatives = F.array(*(F.array(*(F.lit(j) for j, u in enumerate(names) if _near(t, u, threshold))).cast("array<int>") for t in names))
    better = lambda o, m: (o["share"] > m["share"]) | (o["share"] == m["share"]) & ((o["size"] > m["size"]) | (o["size"] == m["size"]) & (o["template"] < m["template"]))
    beaten = lambda m: F.exists("all", lambda o: F.array_contains(F.get(relatives, m["template"]), o["template"]) & better(o, m))
    kept = of_para.select("row", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("m"))
    hits = kept.groupBy("row").agg(F.collect_set("m.label").alias("more"), F.max("m.share").alias("best"))
    out = base.drop("held", "paragraphs").join(hits, "row", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _lowest(f, columns: list[Column]) -> Column:
    return f(*columns) if len(columns) > 1 else columns[0]
