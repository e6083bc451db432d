"""License scans by a positional rare-token index.

A template is a notice or the grant of a licence, as words, with one mandatory phrase in it (of a short notice, all of
it). Its RARE rarest words, the phrase's first, have postings (template, position), weighed by their IDF over all
templates. Of a text only the positions of posted words are taken; a posting at q met at p votes for the template
standing at p - q, and only where enough words agree is the mandatory phrase compared word by word. As many votes are
asked as the phrase itself has postings, so no occurrence of a mandatory phrase is missed, whatever surrounds it.

Plan: built-in functions over one pass, no shuffle: texts without any phrase's rarest word (one `rlike`) are not split at all.
Cases: null texts are empty; texts without words have n_words 0 and no labels; repeated rows are judged each for
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Label and mandatory key phrase of the base.
BASE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: The method's own labels: label and mandatory key phrase.
MORE_PHRASES = [
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "released into the public domain"),
]

#: Grants and preambles: label, mandatory key phrase, and the text around it.
TEXTS = [
    (
        "mit",
        "to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "isc",
        "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "0bsd",
        "for any purpose with or without fee is hereby granted the software is provided as is",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties",
    ),
    (
        "zlib",
        "the origin of this software must not be misrepresented",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "bsl-1",
        "to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    (
        "epl",
        "eclipse public license",
        "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    ),
    (
        "artistic",
        "artistic control over the development of",
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
    ),
    ("artistic", "the artistic license", "the artistic license preamble"),
    ("unlicense", "this is free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "creative commons attribution sharealike", "creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "creative commons attribution noncommercial 4 0 international public license"),
]
#: Posted words of a template, and of its mandatory phrase.
RARE, AGREEING = 6, 3
#: Words of any English text: they count as words of all templates.
COMMON = set("a an and any as at by for from in into is not of on or over that the this to under use with without".split())


class RareTokenIndex:
    """Postings of the rarest words of each template (highest IDF over all templates, then the longest)."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.labels = [label for label, _, _ in templates]
        self.phrases = [phrase.split() for _, phrase, _ in templates]
        texts = [text.split() for _, _, text in templates]
        seen = Counter(w for words in texts for w in set(words))
        self.idf = {w: math.log((1 + len(texts)) / (len(texts) if w in COMMON else n)) for w, n in seen.items()}
        self.offset, self.rare, self.votes, self.posted = [], set(), [], {}
        for k, (phrase, words) in enumerate(zip(self.phrases, texts, strict=True)):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            inside = range(at, at + len(phrase))
            order = sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], -len(words[i]), i))  # noqa: B023
            own = [i for i in order if i in inside][:AGREEING]
            self.offset.append(at)
            self.votes.append(len(own))
            self.rare.add(words[own[0]])
            for i in [*own, *(i for i in order if i not in own)][:RARE]:
                self.posted.setdefault(words[i], []).append((k, i))

    def postings(self, word: Column) -> Column:
        """Array of (template, position) for a posted word."""
        table = F.create_map(*(c for w in sorted(self.posted) for c in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a")) for k, a in self.posted[w])))))
        return F.element_at(table, word)

    def agreed(self, votes: str) -> Column:
        """The places (k, start) of a sorted array of votes that have enough of them, each once."""
        enough = F.array(*map(F.lit, self.votes))

        def last_needed(v: Column, i: Column) -> Column:
            first = i - F.get(enough, v["k"]) + 1
            return F.get(F.col(votes), first).eqNullSafe(v) & ~F.get(F.col(votes), first - 1).eqNullSafe(v)

        return F.filter(votes, last_needed)

    def phrase_at(self, words: Column, k: Column, start: Column) -> Column:
        table = F.create_map(*(c for k_, w in enumerate(self.phrases) for c in (F.lit(k_), F.array(*map(F.lit, w)))))
        phrase = F.element_at(table, k)
        at = start + F.get(F.array(*map(F.lit, self.offset)), k)
        return (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, F.size(phrase)) == phrase)


def scan(docs: DataFrame, base=BASE_PHRASES, more=MORE_PHRASES, texts=TEXTS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    index = RareTokenIndex([*((label, phrase, phrase) for label, phrase in [*base, *more]), *texts])
    low = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    plain = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++", " "))
    rows = docs.select("doc_id", plain.alias("plain"))
    n = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    hot = F.col("plain").rlike(r"(?:^| )(?:" + "|".join(sorted(index.rare)) + r")(?: |$)")
    rows = rows.select("doc_id", n.cast("long").alias("n_words"), F.when(hot, F.split("plain", " ")).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(index.posted)), F.struct(i.alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    rows = rows.withColumn("at", at)
    votes = F.flatten(F.transform("at", lambda x: F.transform(index.postings(x["w"]), lambda y: F.struct(y["k"].alias("k"), (x["p"] - y["a"]).alias("start")))))
    rows = rows.withColumn("votes", F.array_sort(votes))
    places = F.filter(index.agreed("votes"), lambda v: index.phrase_at(F.col("words"), v["k"], v["start"]))
    rows = rows.select("doc_id", "n_words", F.coalesce(places, F.array().cast("array<struct<k:int,start:int>>")).alias("places"))
    rows = rows.withColumn("base", F.transform(F.filter("places", lambda v: v["k"] < len(base)), lambda v: v["start"].cast("long")))
    names = F.array(*map(F.lit, index.labels))
    labels = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda v: F.get(names, v["k"])))), ",")
    weight = F.array(*(F.lit(float(sum(index.idf[w] for w in words))) for words in index.phrases))
    evidence = F.aggregate("places", F.lit(0.0), lambda acc, v: acc + F.get(weight, v["k"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base").alias("first_word"),
        F.array_max("base").alias("last_word"),
        labels(F.filter("places", lambda v: v["k"] < len(base))).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        (evidence / (evidence + 1)).alias("score"),
    )
