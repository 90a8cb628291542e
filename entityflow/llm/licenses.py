"""Operator 7 (native): licence scan with a positional index of rare tokens.

``TEMPLATES`` are word sequences of licences with a mandatory key phrase each; the index lists, for each rare word of
the templates, its (template, position) postings. Step one reads a text once and keeps the places of the base phrases,
of the key phrases and of the index's words. Step two counts in how many documents each index word occurs (a table of
at most the vocabulary's size). Step three takes each file's ``TOP_WORDS`` licence words of the highest inverse document
frequency and all index words of the templates whose key phrase stands in it, so that no standing key phrase goes
without its votes (each holds two index words at least), turns their places into (template, start) by the postings' relative positions, keeps the starts on which at
least ``MIN_SUPPORT`` of its words agree, and verifies that the template's key phrase stands where that start puts it.
DataFrame functions only.

A base phrase adds its label wherever its words stand consecutively; a verified template adds its own label.
The score is 1 for a base phrase, else the best start's share of its template's rare words.

Scale: row expressions over the scan, plus one pre-aggregated count by word. Texts without any word of the phrases'
first words skip the search for places by one pattern; their words are counted all the same. Votes are counted by
sorting, in O(n log n) of a text's licence words.

Cases: a null or empty text has no words, no place and empty labels. Repeated rows get equal results. No rows: no rows.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityflow.llm.common import JAVA_SEPARATORS, bind, materialize, without

#: Fixed values of the contract: phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: label: (template, mandatory key phrase inside it). Wordings of well-known licence notices.
TEMPLATES = {
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    "gpl": ("under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    "apache": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance with the license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "cc": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    "cc-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    "epl": ("made available under the terms of the eclipse public license v 2 0", "eclipse public license"),
}
#: Words too common to be indexed.
COMMON = frozenset("a and any are as at be by for form free in is it made may not of or that the this to under use with without work you v 2 4 0".split())
TOP_WORDS = 6
MIN_SUPPORT = 2
RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def postings() -> dict[str, list[tuple[str, int]]]:
    """Rare word to its (label, position) pairs."""
    out: dict[str, list[tuple[str, int]]] = {}
    for label, (text, _) in TEMPLATES.items():
        for at, word in enumerate(text.split()):
            if word not in COMMON:
                out.setdefault(word, []).append((label, at))
    return out


def _rare_words() -> dict[str, int]:
    return {label: len({w for w in text.split() if w not in COMMON}) for label, (text, _) in TEMPLATES.items()}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _starts(words: Column, phrase: str) -> Column:
    """Array of struct(at, phrase) where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        out = F.lit(True)
        for k, word in enumerate(rest, 1):
            out = out & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return out

    starts = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    return F.transform(F.filter(starts, here), lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(phrase).alias("phrase")))


def _places(words: Column, phrases: list[str]) -> Column:
    """The starts of all phrases; the array of words is bound."""
    return F.concat(*[_starts(words, p) for p in phrases])


def read(documents: DataFrame) -> DataFrame:
    """``documents`` with n_words, _phrases (base and key phrases), _rare (places of the index's words) and _words.

    _phrases and _rare are filled where a phrase can stand; _words, the distinct index words, for every text.
    """
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.split(text, JAVA_SEPARATORS)
    n_words = lambda p: (  # noqa: E731  the pieces between separators, without an empty first and last one
        F.size(p)
        - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    ).cast("bigint")
    phrases = list(dict.fromkeys([*BASE, *[key for _, key in TEMPLATES.values()]]))
    anchors = sorted({p.split()[0] for p in phrases})
    index = sorted(postings())
    words = F.filter(F.split(lowered, JAVA_SEPARATORS), lambda w: w != "")
    rare = lambda ws: F.filter(
        F.transform(ws, lambda w, i: F.struct(i.cast("bigint").alias("at"), w.alias("word"))), lambda x: x["word"].isin(index)
    )
    held = lambda ws: F.array_intersect(ws, _strings(index))
    both = bind(words, lambda ws: F.struct(held(ws).alias("words"), _places(ws, phrases).alias("phrases"), rare(ws).alias("rare")))
    anywhere = text.rlike(r"(?i)(?<![0-9a-z\x{80}-\x{10FFFF}])(?:" + "|".join(anchors) + r")(?![0-9a-z\x{80}-\x{10FFFF}])")
    docs = without(documents, [*RESULT, "_found", "_more", "_keyed", "_phrases", "_rare", "_words", "_pieces"])
    docs = docs.withColumn("n_words", bind(pieces, n_words))
    docs = docs.withColumn("_found", F.when(anywhere, both))
    none = F.array().cast("array<struct<at:bigint,phrase:string>>"), F.array().cast("array<struct<at:bigint,word:string>>")
    return docs.withColumns(
        {
            "_phrases": F.coalesce("_found.phrases", none[0]),
            "_rare": F.coalesce("_found.rare", none[1]),
            "_words": F.coalesce("_found.words", held(F.split(lowered, JAVA_SEPARATORS))),
        }
    ).drop("_found")


def inverse_frequencies(read_docs: DataFrame) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each index word; at most the vocabulary's size."""
    words = read_docs.select(F.explode("_words").alias("word")).groupBy("word").count()
    n = read_docs.select("n_words").count()
    found = {r["word"]: r["count"] for r in words.collect()}
    return {w: math.log((1 + n) / (1 + found.get(w, 0))) for w in postings()}


def match(read_docs: DataFrame, idf: dict[str, float]) -> DataFrame:
    """The contract's columns from ``read``'s."""
    index, sizes = postings(), _rare_words()
    rank = sorted(index, key=lambda w: (-idf[w], w))  # rarest first; ties by the word
    order = F.create_map(*[x for k, w in enumerate(rank) for x in (F.lit(w), F.lit(k))])
    pair = lambda t, s: F.struct(t.alias("label"), s.alias("start"))
    lists = F.create_map(
        *[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("label"), F.lit(a).cast("bigint").alias("at")) for t, a in ps]))]
    )
    offsets = {key: [(label, text[: text.index(key)].count(" ")) for label, (text, k) in TEMPLATES.items() if k == key] for _, key in TEMPLATES.values()}
    keys = F.create_map(
        *[x for p, ps in offsets.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(t).alias("label"), F.lit(a).cast("bigint").alias("at")) for t, a in ps]))]
    )
    starts = lambda places, table, name: F.flatten(
        F.transform(places, lambda o: F.transform(table[o[name]], lambda p: pair(p["label"], o["at"] - p["at"])))
    )
    top = F.slice(F.array_sort(F.array_distinct(F.transform("_rare", lambda x: order[x["word"]]))), 1, TOP_WORDS)
    keyed = F.array_distinct(starts(F.filter("_phrases", lambda p: F.map_contains_key(keys, p["phrase"])), keys, "phrase"))
    of = F.create_map(*[x for label in TEMPLATES for x in (F.lit(label), _strings(w for w, ps in index.items() if label in dict(ps)))])
    more = F.array_distinct(F.flatten(F.transform("_keyed", lambda k: of[k["label"]])))
    docs = read_docs.withColumns({"_top": top, "_keyed": keyed}).withColumn("_more", more)
    chosen = F.filter("_rare", lambda x: F.array_contains("_top", order[x["word"]]) | F.array_contains("_more", x["word"]))

    def agreed(votes: Column) -> Column:
        """(label, start, number of votes) of each start; ``votes`` is sorted, and bound."""
        last = F.filter(
            F.transform(votes, lambda v, k: F.struct(v["label"].alias("label"), v["start"].alias("start"), k.alias("k"), (F.coalesce(F.get(votes, k + 1) != v, F.lit(True))).alias("last"))),
            lambda v: v["last"],
        )
        return bind(
            last,
            lambda ends: F.transform(
                ends, lambda e, k: F.struct(e["label"].alias("label"), e["start"].alias("start"), (e["k"] - F.coalesce(F.get(ends, k - 1)["k"], F.lit(-1))).alias("n"))
            ),
        )

    # A place and a template's word make one vote, so a start's votes are distinct words of the file at their places.
    voted = F.filter(bind(F.sort_array(starts(chosen, lists, "word")), agreed), lambda v: v["n"] >= MIN_SUPPORT)
    docs = docs.withColumn("_voted", voted)
    docs = docs.withColumn("_sure", F.array_intersect(F.transform("_voted", lambda v: pair(v["label"], v["start"])), F.col("_keyed")))
    base = F.filter("_phrases", lambda p: p["phrase"].isin(list(BASE)))
    labels = F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])
    words = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    docs = docs.withColumn("_base", base).withColumn("_names", F.array_distinct(F.transform("_base", lambda b: labels[b["phrase"]])))
    share = F.array_max(
        F.transform(
            F.filter("_voted", lambda v: F.array_contains(F.transform("_sure", lambda s: s["label"]), v["label"])),
            lambda v: F.least(F.lit(1.0), v["n"].cast("double") / words[v["label"]]),
        )
    )
    all_names = F.array_union(F.col("_names"), F.transform("_sure", lambda s: s["label"]))
    out = docs.withColumns(
        {
            "n_base": F.size("_base").cast("bigint"),
            "first_word": F.array_min(F.col("_base.at")),
            "last_word": F.array_max(F.col("_base.at")),
            "base_labels": F.array_join(F.array_sort("_names"), ","),
            "labels": F.array_join(F.array_sort(all_names), ","),
            "score": F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))),
        }
    )
    return out.drop("_phrases", "_rare", "_words", "_top", "_more", "_voted", "_keyed", "_sure", "_base", "_names")


def scan_licenses(documents: DataFrame) -> DataFrame:
    """``documents`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    What ``read`` found is written to the shared folder once, as both the word counts and the matching need it; pass
    only the columns to return.
    """
    found = materialize(read(documents).drop("text"), "licence-words")
    return match(found, inverse_frequencies(found))
