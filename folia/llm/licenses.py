"""License scans by a positional rare-token index, in DataFrame functions only.

The corpus's document frequencies choose, for each notice (a base phrase or a template), the RARE words of its mandatory key
phrase with the highest IDF. The index posts for each of these words the notices that have it and its place in their key phrase. A
file is looked up by its own words of the index, its licence words of the highest IDF: every occurrence gives, for each posting, the
relative position at which that key phrase would start. Starts on which the postings of all rare words of a notice fall together are
verified word by word. Every place of a key phrase holds its rare words, so no place is lost. Only files that hold such a
word are cut into words; documents need no shuffle, and only one row of counts is aggregated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Rare words of a key phrase whose postings are intersected, where it has as many.
RARE = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Notice:
    """A licence notice: words, and the mandatory key phrase words[start : start + length]."""

    label: str
    words: tuple[str, ...]
    start: int
    length: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.start : self.start + self.length]


def notice(label: str, text: str, key: str = "", base: bool = False) -> Notice:
    words, key_words = tuple(text.split()), tuple((key or text).split())
    start = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
    return Notice(label, words, start, len(key_words), base)


#: The base phrases.
BASE = [
    notice("mit", "mit license", base=True),
    notice("apache", "apache license", base=True),
    notice("gpl", "general public license", base=True),
]

# The beginnings of well-known notices, with their mandatory key phrases, in lower case without punctuation.
TEMPLATES = [
    notice("mit", "released under the mit license", "mit license"),
    notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "free of charge to any person obtaining a copy",
    ),
    notice("apache", "licensed under the apache license version 2 0", "apache license"),
    notice(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "apache license version 2 0",
    ),
    notice("apache-2.0", "http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    notice("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    notice("gpl-2.0", "under the terms of the gnu general public license version 2", "gnu general public license version 2"),
    notice(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "gnu general public license as published by the free software foundation",
    ),
    notice("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    notice("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    notice("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    notice("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    notice("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    notice("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "names of its contributors may be used to endorse"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages arising from the use"),
    notice("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    notice("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    notice("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    notice("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    notice("cc0", "creative commons cc0 1 0 universal", "cc0 1 0"),
    notice("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    notice("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    notice("all-rights-reserved", "all rights reserved"),
]

# Identifiers of the SPDX list that a tag line may name.
SPDX = [
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "Artistic-2.0",
]
TEMPLATES += [notice(f"spdx:{x}", "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")) for x in SPDX]


def _sql(value: str | tuple[str, ...]) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"array({', '.join(map(_sql, value))})"


def _array(words) -> Column:
    return F.expr(_sql(tuple(words)))


def _once(df: DataFrame, column: str) -> DataFrame:
    """Makes a column's expression run once a row, however often later steps name it: Catalyst inlines no generator."""
    return df.withColumn(column, F.explode(F.array(column)))


def document_frequencies(lowered: DataFrame, column: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents in all, and those whose text holds each word of the notices, be it inside a longer one: one row of counts."""
    row = lowered.agg(F.count("*").alias("n"), *[F.sum(F.contains(F.col(column), F.lit(w)).cast("long")).alias(f"w{i}") for i, w in enumerate(vocabulary)]).first()
    return row["n"], {w: row[f"w{i}"] or 0 for i, w in enumerate(vocabulary)}


def rare_words(notices: list[Notice], n: int, counts: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each notice the distinct words of its key phrase with the highest IDF (ties: the earlier), rarest first, and their places in the key phrase."""
    out = []
    for x in notices:
        idf = [math.log((n + 1) / (counts.get(w, 0) + 1)) for w in x.key]
        first = [i for i, w in enumerate(x.key) if w not in x.key[:i]]
        out.append([(x.key[i], i) for i in sorted(first, key=lambda i: (-idf[i], i))[:RARE]])
    return out


def postings(rare: list[list[tuple[str, int]]]) -> dict[str, list[tuple[int, int]]]:
    """The index: for each rare word the notices that have it, and its place in their key phrase."""
    out: dict[str, list[tuple[int, int]]] = {}
    for n, words in enumerate(rare):
        for w, at in words:
            out.setdefault(w, []).append((n, at))
    return out


def _meeting(hits: str, rare: list[list[tuple[str, int]]]) -> Column:
    """Notices and starts (array of struct<n, s>, in order) on which the postings of all rare words fall together. hits: array of struct<w, i>."""
    posted = ", ".join(f"{_sql(w)}, array({', '.join(f"named_struct('n', {n}, 'at', {at})" for n, at in found)})" for w, found in postings(rare).items())
    starts = F.expr(f"array_sort(flatten(transform(`{hits}`, h -> transform(map({posted})[h.w], p -> named_struct('n', p.n, 's', h.i - p.at)))))")
    need = F.array(*[F.lit(len(words)) for words in rare])
    # each of a notice's rare words gives a start once, so as many equal neighbours as words stand for agreement
    return F.transform(F.array(starts), lambda a: F.filter(a, lambda x, k: F.get(a, k + F.get(need, x["n"]) - 1).eqNullSafe(x) & ((k == 0) | ~F.get(a, k - 1).eqNullSafe(x))))[0]


def scan_licenses(docs: DataFrame, text: str = "text", notices: list[Notice] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Finds the notices in every whole text.

    Returns the kept columns, n_words, places (array of struct<label, base, start, score>: label and base of the notice,
    index of the first word of its key phrase, share of the notice's words that stand where the notice has them), in the
    order of the notices, then of places. Null and empty texts have no words and no places; equal rows give equal rows. Kept
    columns named n_words or places are replaced.
    """
    notices = [*BASE, *TEMPLATES] if notices is None else notices
    keep = tuple(c for c in keep if c not in ("n_words", "places"))
    low, parts, at, meet = "license text, lowered", "license text, words", "license text, hits", "license text, starts"
    lowered = docs.select(*keep, lower_ascii(text).alias(low))
    n, counts = document_frequencies(lowered, low, sorted({w for x in notices for w in x.key}))
    rare = rare_words(notices, n, counts)
    index = postings(rare)
    held = F.lit(False)
    for w in sorted({words[0][0] for words in rare}):  # a file without any notice's rarest word has no place
        held = held | F.contains(F.col(low), F.lit(w))
    lowered = _once(lowered, low)
    words = F.when(held, F.regexp_extract_all(F.col(low), F.lit(f"({WORD})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    n_words = F.regexp_count(F.col(low), F.lit(f"{WORD}+")).cast("long")  # a possessive run: no way back to try
    worded = _once(lowered.select(*keep, n_words.alias("n_words"), words.alias(parts)), parts)
    hits = F.filter(F.transform(parts, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(_array(sorted(index)), x["w"]))
    hits = F.when(F.arrays_overlap(parts, _array(sorted(index))), hits).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    found = _once(worded.withColumn(at, hits), at)
    met = F.when(F.size(at) > 0, _meeting(at, rare)).otherwise(F.array().cast("array<struct<n:int,s:int>>"))
    found = _once(found.withColumn(meet, met), meet)

    constant = ", ".join(f"named_struct('label', {_sql(x.label)}, 'base', {str(x.base).lower()}, 'words', {_sql(x.words)}, 'key', {_sql(x.key)}, 'start', {x.start})" for x in notices)
    verified = F.expr(f"""transform(
        filter(transform(`{meet}`, m -> named_struct('n', get(array({constant}), m.n), 's', m.s)), m -> m.s >= 0 AND slice(`{parts}`, greatest(m.s + 1, 1), size(m.n.key)) = m.n.key),
        m -> named_struct('label', m.n.label, 'base', m.n.base, 'start', CAST(m.s AS BIGINT), 'score',
            size(filter(m.n.words, (w, k) -> m.s - m.n.start + k >= 0 AND coalesce(get(`{parts}`, m.s - m.n.start + k) = w, false))) / CAST(size(m.n.words) AS DOUBLE)))""")
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,score:double>>")
    return _once(found.select(*keep, "n_words", F.when(F.size(meet) > 0, verified).otherwise(none).alias("places")), "places")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base phrases, labels of all notices and the best notice's score, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform("base", lambda p: p["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    # the score is that of templates: a base phrase alone doesn't say how much of a notice stands there
    best = F.array_max(F.transform(F.filter("places", lambda p: ~p["base"]), lambda p: p["score"]))
    return (
        scan_licenses(docs).withColumn("base", base)
        .select(
            "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
            labels("base").alias("base_labels"), labels("places").alias("labels"), F.round(F.coalesce(best, F.lit(0.0)), 9).alias("score"),
        )
    )


def oracle() -> str:
    """DuckDB SQL for op1_license_scan, by plain enumeration of every word position."""
    rows = ", ".join(
        f"('{x.label}', {str(x.base).lower()}, {x.start}, {x.length}, [{', '.join(repr(w) for w in x.words)}], [{', '.join(repr(w) for w in x.key)}])" for x in [*BASE, *TEMPLATES]
    )
    return f"""
    WITH notices(label, base, koff, klen, words, kwords) AS (VALUES {rows}),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
    f AS (SELECT doc_id, label, base, s - 1 AS start, len(list_filter(range(1, len(words) + 1),
          lambda k: s - koff + k - 1 >= 1 AND w[s - koff + k - 1] = words[k])) / len(words) AS score
          FROM p JOIN notices ON w[s] = kwords[1] AND w[s : s + klen - 1] = kwords),
    g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
          coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
          array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) FILTER (NOT base) AS score FROM f GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
      CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 9) AS score
    FROM d LEFT JOIN g USING (doc_id)"""
