"""License scan by a positional rare-token index, in DataFrame functions alone.

Templates of licence sentences are indexed by word: (template, position).  A file's words that the index knows are
looked up with their inverse document frequency over the whole corpus; for each template the file's highest-IDF word
is the anchor, and every posting of an anchor proposes where the template would start.  A proposal stands if the
template's words agree at their relative positions (COVER of them at least) and its mandatory key phrase stands at its
own place.

Base labels come from places where a phrase's words stand consecutively.  Words are lower-cased (A-Z only) runs of
letters, digits and characters beyond ASCII.  Null and empty texts have no words, places or labels and score 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates as (label, words, mandatory key phrase).
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl-freedom", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "without limitation the rights to use",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0",
        "in compliance with the license",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        "endorse or promote products",
    ),
    (
        "gpl-warranty",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose",
        "in the hope that it will be useful",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "this permission notice appear in all copies",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software",
        "will the authors be held liable",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
#: Words too common to be looked up.
STOP = frozenset("a all and any are as by can for in is it of or that the this to under use with without you".split())
COVER = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _postings() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(TEMPLATES):
        for p, w in enumerate(words.split()):
            if w not in STOP:
                out.setdefault(w, []).append((t, p))
    return out


POSTINGS = _postings()
#: Words whose places are kept: those of the index and the first word of each base phrase.
KNOWN = sorted(POSTINGS.keys() | {p.split()[0] for p, _ in PHRASES})


def words_column(text: str = "text") -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SEPARATORS, -1), lambda w: w != "")


def _at(words: Column, start: Column, phrase: str) -> Column:
    """Whether the phrase's words stand in words from start on."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(words, start + k) == w, F.lit(False)) for k, w in enumerate(phrase.split())])


def _literal_ints(rows: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in rows])


def document_frequencies(words: DataFrame) -> DataFrame:
    """One row: rows of the corpus, and for each index word the rows that hold it.  Bounded by the index's words."""
    held = words.select(F.explode(F.array_distinct(F.filter("hits", lambda h: h["w"].isin(sorted(POSTINGS)))["w"])).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return held.agg(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))), F.create_map().cast("map<string,bigint>")).alias("df"))


def _places(phrase: str, label: str) -> Column:
    first = F.filter("hits", lambda h: (h["w"] == phrase.split()[0]) & _at(F.col("words"), h["i"], phrase))
    return F.transform(first, lambda h: F.struct(h["i"].alias("i"), F.lit(label).alias("label")))


def _cover(t: int, own: list[str], key: str, place: int) -> Column:
    """The best share of template t's words that agree where an anchor puts them and the key phrase stands; else null."""
    mine = F.filter("proposals", lambda p: p["t"] == t)
    least = F.array_min(F.transform(mine, lambda p: p["n"]))
    starts = F.array_distinct(F.transform(F.filter(mine, lambda p: p["n"] == least), lambda p: p["start"]))
    proved = F.filter(starts, lambda s: (s + place >= 0) & _at(F.col("words"), s + place, key))

    def agree(s: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.get("words", s + k) == w, F.lit(False)).cast("int") for k, w in enumerate(own)])

    return F.when(F.size(mine) > 0, F.array_max(F.transform(proved, lambda s: agree(s) / F.lit(float(len(own))))))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of (doc_id, text).

    labels adds the templates' labels to the base labels; score is the best share of a template's words that agree, at
    least 0.5 where a base phrase stands, else 0.  Two scans of the texts and no shuffle but the word counts.
    """
    split = documents.select("doc_id", words_column().alias("words"))
    hit = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(KNOWN))
    some = F.exists("words", lambda w: w.isin(KNOWN))
    found = split.withColumn("hits", F.when(some, hit).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    counted = found.crossJoin(F.broadcast(document_frequencies(found)))

    base = counted.withColumn("base", F.flatten(F.array(*[_places(phrase, label) for phrase, label in PHRASES])))

    index = F.create_map(*[x for w, rows in sorted(POSTINGS.items()) for x in (F.lit(w), _literal_ints(rows))])
    # rarer words have smaller counts, so the least count is the highest IDF whatever the corpus size
    proposals = F.flatten(F.transform(F.filter("hits", lambda h: h["w"].isin(sorted(POSTINGS))), lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("start"), F.element_at(F.col("df"), h["w"]).alias("n")))))
    base = base.withColumn("proposals", F.when(F.size("hits") > 0, proposals).otherwise(F.array().cast("array<struct<t:int,start:int,n:bigint>>")))
    covers = [_cover(t, words.split(), key, len(words[: words.index(key)].split())) for t, (_, words, key) in enumerate(TEMPLATES)]
    covered = base.withColumn("covers", F.when(F.size("proposals") > 0, F.array(*covers)).otherwise(F.array().cast("array<double>")))
    good = F.filter(F.transform("covers", lambda c, i: F.struct(c.alias("c"), F.element_at(F.array(*[F.lit(x[0]) for x in TEMPLATES]), i + 1).alias("label"))), lambda x: x["c"] >= COVER)
    out = covered.withColumn("good", good)
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    return out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["i"])).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(base_labels)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base_labels, F.transform("good", lambda g: g["label"])))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("good", lambda g: g["c"])), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
