"""License scan by diagonal voting of rolling word k-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of the contract and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of public licenses, in the words the scan sees.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-notice": "work is licensed under the gnu general public license version",
    "gpl-text": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}

K = 3
#: Diagonals at most this far apart are merged; a span with this share of a template's k-grams counts.
SLACK, COVERAGE, STRETCH = 8, 0.6, 1.5

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does that at once; it changes other letters too, which no
    phrase or template holds, except that two characters would become ASCII ones; texts with
    those go letter by letter.
    """
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(odd, plain).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), _BETWEEN), "")


def _phrase_starts(phrase: str) -> Column:
    """Places (from 0) in ``_words`` where the phrase's words stand one after another."""
    words = phrase.split()

    def stands(i: Column) -> Column:
        held = F.get("_words", i) == words[0]
        for ahead, word in enumerate(words[1:], 1):
            held = held & (F.get("_words", i + ahead) == word)
        return held

    places = F.filter(F.sequence(F.lit(0), F.size("_words") - len(words)), stands)
    # Only texts that hold the rarest words at all are walked through.
    may = (F.size("_words") >= len(words)) & F.array_contains("_words", words[0]) & F.array_contains("_words", words[-2])
    return F.when(may, places).otherwise(F.array().cast("array<int>"))


def template_grams(spark, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """One row per template position; a fixed table of a few hundred rows."""
    rows = [
        (label, at, " ".join(words[at : at + k]), len(words) - k + 1)
        for label, text in templates.items()
        for words in [text.split()]
        for at in range(len(words) - k + 1)
    ]
    table = spark.createDataFrame(rows, "label string, _tpos int, _gram string, _n_grams int")
    return table.withColumn("_hash", F.expr("xxhash64(split(_gram, ' ')[0], split(_gram, ' ')[1], split(_gram, ' ')[2])"))


def template_spans(docs: DataFrame) -> DataFrame:
    """Verified spans: _row, label, first word, last word, coverage.

    Every rolling word k-gram hash of every text meets the template positions in a join whose
    build side is the fixed template table, so no k-gram is shuffled. Matches vote for their
    diagonal (document place minus template place); neighbouring diagonals, as small
    insertions and omissions make them, are merged; a span counts when the words were equal
    (not only the hashes), it covers ``COVERAGE`` of the template's k-grams and is at most
    ``STRETCH`` times as long. Where spans of several templates overlap, as those of one
    family of licenses do, the best covered stand.
    """
    grams = F.broadcast(template_grams(docs.sparkSession))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_words") - K),
        lambda i: F.xxhash64(*[F.get("_words", i + ahead) for ahead in range(K)]),
    )
    matches = (
        docs.select("_row", "_words")
        .where(F.size("_words") >= K)
        .select("_row", "_words", F.posexplode(hashes).alias("_pos", "_hash"))
        .join(grams, "_hash")
        .where(F.concat_ws(" ", *[F.get("_words", F.col("_pos") + ahead) for ahead in range(K)]) == F.col("_gram"))
        .select("_row", "label", "_pos", "_tpos", "_n_grams", (F.col("_pos") - F.col("_tpos")).alias("_diagonal"))
    )
    votes = matches.groupBy("_row", "label", "_diagonal").agg(
        F.collect_set("_tpos").alias("_held"), F.min("_pos").alias("_from"), F.max("_pos").alias("_to"), F.first("_n_grams").alias("_n_grams")
    )
    along = Window.partitionBy("_row", "label").orderBy("_diagonal")
    apart = F.col("_diagonal") - F.lag("_diagonal").over(along)
    merged = (
        votes.withColumn("_new", F.when(apart <= SLACK, 0).otherwise(1))
        .withColumn("_group", F.sum("_new").over(along))
        .groupBy("_row", "label", "_group")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("_held")))).alias("_covered"),
            F.min("_from").alias("first"),
            (F.max("_to") + K - 1).alias("last"),
            F.first("_n_grams").alias("_n_grams"),
        )
    )
    spans = merged.withColumn("coverage", F.col("_covered") / F.col("_n_grams")).where(
        (F.col("coverage") >= COVERAGE) & (F.col("last") - F.col("first") + 1 <= STRETCH * (F.col("_n_grams") + K - 1))
    )
    # Spans are short, so those that overlap one begin within a fixed distance of it.
    reach = int(STRETCH * max(len(t.split()) for t in TEMPLATES.values())) + 1
    near = Window.partitionBy("_row").orderBy("first").rangeBetween(-reach, reach)
    return spans.withColumn("_near", F.collect_list(F.struct("first", "last", "coverage")).over(near)).where(
        ~F.exists("_near", lambda o: (o["first"] <= F.col("last")) & (o["last"] >= F.col("first")) & (o["coverage"] > F.col("coverage")))
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    Base labels come from the contract's phrases, the others from template spans. The score
    is 1 with a base label, else the best span's coverage, else 0. Null text is empty. Rows
    equal in id and text are answered alike, each on its own row; extra columns are not read;
    an empty table gives no rows. Labels are sorted and comma-joined, '' if none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("_row"), words_of(text).alias("_words")
    )
    starts = [_phrase_starts(p).alias(f"_p{i}") for i, p in enumerate(PHRASES)]
    everywhere = F.concat(*[f"_p{i}" for i in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    base = worded.select("doc_id", "_row", F.size("_words").cast("long").alias("n_words"), *starts).select(
        "doc_id",
        "_row",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(named)).alias("_base"),
    )
    spans = template_spans(worded).groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("coverage").alias("_best"))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return base.join(spans, "_row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
