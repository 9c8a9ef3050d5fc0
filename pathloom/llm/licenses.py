"""License scans by diagonal voting, in DataFrame functions only.

All rolling two-word hashes of a text are joined to the positions that the
templates have them at.  A hit votes for the diagonal *text position minus
template position*; votes are aggregated by diagonal, neighbouring diagonals
(words put in or left out shift the rest) are merged, and a merged span is
verified by the share of the template's word pairs that stand on it, each
counted once.  Where the merged span is too long for one notice, as among many
repetitions, its best single diagonal is verified instead.

Three templates are exact phrases with a label each; there a place counts when
all the phrase's pairs vote for one and the same diagonal.

Defined cases: a null or empty text has no words, no labels and score 0; a
phrase that stands several times counts each time; rows of equal id and text
have equal results and are returned each for itself, and a null id is an
ordinary value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

# The phrases and labels that are always reported.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Notices that the method looks for beside them.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-2.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2",
    "lgpl": "licensed under the gnu lesser general public license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights",
    "apache-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-notice": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "boost-1.0": "distributed under the boost software license version 1 0",
    "agpl-3.0": "this program is licensed under the gnu affero general public license version 3",
    "cc-by-sa-4.0": "licensed under a creative commons attribution sharealike 4 0 international license",
    "all-rights": "all rights reserved no part of this work may be reproduced",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Share of a notice's word pairs that a span needs, and by how much diagonals that are merged may differ.
MIN_SHARE, MERGE = 0.8, 2
#: How much longer than its template a merged span may be.
STRETCH = 1.5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"


def words_of(text):
    """Words of A-Z-lowered text.

    ``lower`` folds more than A-Z, but among the other letters only the Kelvin
    sign becomes a single ASCII letter, so with that one put aside no word is
    told apart differently.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit("ā"))), SEPARATORS), "")


def _templates() -> list[tuple[str, str, bool, list[str]]]:
    return [(f"{kind}:{label}", label, kind == "base", text.split(" ")) for kind, texts in (("base", PHRASES), ("own", NOTICES)) for label, text in texts.items()]


def templates(spark: SparkSession) -> DataFrame:
    """``gram, template, label, exact, at, grams``: a few hundred rows, however large the input."""
    values = ", ".join(f"('{t}', '{label}', {str(exact).lower()}, array({', '.join(repr(w) for w in words)}))" for t, label, exact, words in _templates())
    each = spark.sql(f"select * from values {values} as t(template, label, exact, words)")
    return each.select("template", "label", "exact", (F.size("words") - 1).alias("grams"), F.posexplode(_grams(F.col("words"))).alias("at", "gram"))


def _grams(words):
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.array_compact(pairs)


def scan_licenses(docs: DataFrame, min_share: float = MIN_SHARE, merge: int = MERGE) -> DataFrame:
    """``doc_id, n_words, spans``; a span has template, label, exact, start, end (words) and share.

    Spans of notices are verified; what stays below ``min_share`` is kept with
    ``verified`` false, for the score.
    """
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), words_of(text).alias("words"))
    key = ["doc_id", "row_hash"]
    votes = rows.select(*key, F.posexplode(_grams(F.col("words"))).alias("pos", "gram")).join(F.broadcast(templates(docs.sparkSession)), "gram")
    of = ["template", "label", "exact", "grams"]
    lines = votes.groupBy(*key, *of, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("places"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("end"))
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > merge, F.lit(True))
    one = F.struct(F.size("places").alias("votes"), (-F.col("start")).alias("first"), F.col("end").alias("end"))
    merged = lines.withColumn("island", F.sum(apart.cast("int")).over(along)).groupBy(*key, *of, "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"), F.max(one).alias("best"),
    )
    whole = (F.col("end") - F.col("start")) <= (F.col("grams") + 1) * STRETCH + merge
    pick = lambda name, single: F.when(whole, F.col(name)).otherwise(single)
    share = pick("votes", F.col("best.votes")) / F.col("grams")
    fits = F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise(share >= min_share)
    span = F.struct("template", "label", "exact", pick("start", -F.col("best.first")).cast("long").alias("start"), pick("end", F.col("best.end")).cast("long").alias("end"), share.alias("share"), fits.alias("verified"))
    found = merged.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans")).select(F.col("doc_id").alias("f_doc"), F.col("row_hash").alias("f_row"), "spans")
    counted = rows.select(*key, F.size("words").cast("long").alias("n_words"))
    both = counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("row_hash") == F.col("f_row")), "left")
    return both.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    verified = F.filter("spans", lambda s: s["verified"])
    base = F.filter("spans", lambda s: s["verified"] & s["exact"])
    starts = F.transform(base, lambda s: s["start"])
    # a notice's share counts as far as it goes; the phrases inside it do not make a part of it whole
    best = F.coalesce(F.array_max(F.transform(F.filter("spans", lambda s: s["verified"] | ~s["exact"]), lambda s: s["share"])), F.lit(0.0))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(verified).alias("labels"), best.alias("score"))


_VALUES = ", ".join(f"('{t}', '{label}', {exact}, {len(words) - 1}, {k}, '{words[k]}', '{words[k + 1]}')" for t, label, exact, words in _templates() for k in range(len(words) - 1))
OP8_SQL = f"""
with g(template, label, exact, grams, place, first, second) as (values {_VALUES}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
p as (select doc_id, unnest(ws[:-2]) as first, unnest(ws[2:]) as second, unnest(range(len(ws) - 1)) as pos from d where len(ws) > 1),
lines as (select doc_id, template, label, exact, grams, pos - place as diagonal, list(distinct place) as places, min(pos) as s, max(pos) + 2 as e from p join g using (first, second) group by all),
i as (select *, sum((exact or coalesce(diagonal - before > {MERGE}, true))::int) over (partition by doc_id, template order by diagonal) as island
  from (select *, lag(diagonal) over (partition by doc_id, template order by diagonal) as before from lines)),
m as (select doc_id, template, label, exact, grams, island, len(list_distinct(flatten(list(places)))) as votes, min(s) as s, max(e) as e, max(len(places)) as most from i group by all),
v as (select *, (case when e - s <= (grams + 1) * {STRETCH} + {MERGE} then votes else most end) / cast(grams as double) as share from m),
f as (select *, case when exact then votes = grams else share >= {MIN_SHARE} end as ok from v),
o as (select doc_id, count(*) filter (where ok and exact) as n_base, min(s) filter (where ok and exact) as first_word, max(s) filter (where ok and exact) as last_word,
  string_agg(distinct label, ',' order by label) filter (where ok and exact) as base_labels, string_agg(distinct label, ',' order by label) filter (where ok) as labels, max(share) filter (where ok or not exact) as score from f group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score from d left join o on o.doc_id = d.doc_id
"""
