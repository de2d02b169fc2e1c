"""Licence scans (7), in DataFrame functions only: sentence identifiers against ordered licence rules.

Texts are cut into sentences, once at every line end and once at blank lines only
(licence texts are often wrapped). Sentences are normalised (small letters and
digits, single spaces) and joined with a fixed table of known licence sentences.
The identifiers found in a cut stand in the order of the text, and ordered rules
are matched against each of the two sequences: a rule is a run of identifiers in
their order, with nothing but unknown sentences between them. Rules are tried from
the first to the last; a sentence that a rule has taken is not given to a later one.

Defined cases: a null or empty text has no sentences; a licence that occurs
several times is reported once, its sentences counted each time; repeated rows
are scanned each for itself and reported each; documents without a known sentence
get empty lists; null ids are documents like any other; an empty table gives an
empty result; extra columns are not read; texts are read whole.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence sentences (identifier, normalised words) and, in the order of trial, the rules.
SENTENCES = [
    ("all-rights", "all rights reserved"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice-kept", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache2-grant", "you may not use this file except in compliance with the license"),
    # As the cuts leave them: the headers have ':' and ';' inside, version 2 one more before its version.
    ("gpl-free", "this program is free software"),
    ("gpl3-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-terms", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("later-than-3", "either version 3 of the license or at your option any later version"),
    ("later-than-2", "either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-implied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-free", "this library is free software"),
    ("lgpl21-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-terms", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("later-than-21", "either version 2 1 of the license or at your option any later version"),
    ("agpl3-terms", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl2-source", "this source code form is subject to the terms of the mozilla public license v"),
    ("cc0-waiver", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("spdx-tag", "spdx license identifier"),
]
# Licences (SPDX name, notice identifier, names in a notice), for the sentences of the notice families and of tags.
NAMED = [
    ("MIT", "mit-notice", ["the mit license", "the mit licence", "mit license"]),
    ("Apache-2.0", "apache2-notice", ["the apache license version 2 0", "the apache license version 2 0 the license", "the apache license 2 0", "the apache 2 0 license", "apache license version 2 0"]),
    ("GPL-3.0-only", "gpl3-notice", ["the gnu general public license version 3", "the gnu general public license v3", "the gnu gpl version 3", "the gplv3"]),
    ("GPL-2.0-only", "gpl2-notice", ["the gnu general public license version 2", "the gnu general public license v2", "the gnu gpl version 2", "the gplv2"]),
    ("LGPL-3.0-only", "lesser3-notice", ["the gnu lesser general public license version 3", "the gnu lgpl version 3", "the lgplv3"]),
    ("LGPL-2.1-only", "lesser21-notice", ["the gnu lesser general public license version 2 1", "the gnu lgpl version 2 1", "the lgplv2 1"]),
    ("AGPL-3.0-only", "affero3-notice", ["the gnu affero general public license version 3", "the gnu agpl version 3", "the agplv3"]),
    ("MPL-2.0", "mpl2-notice", ["the mozilla public license version 2 0", "the mozilla public license 2 0", "the mpl 2 0"]),
    ("BSD-3-Clause", "bsd3-notice", ["the bsd 3 clause license", "the 3 clause bsd license"]),
    ("BSD-2-Clause", "bsd2-notice", ["the bsd 2 clause license", "the 2 clause bsd license"]),
    ("ISC", "isc-notice", ["the isc license", "isc license"]),
    ("CC0-1.0", "cc0-notice", ["cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 license"]),
    ("CC-BY-NC-4.0", "ccbync4-notice", ["cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license"]),
    ("CC-BY-SA-4.0", "ccbysa4-notice", ["cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license"]),
    ("CC-BY-4.0", "ccby4-notice", ["cc by 4 0", "a creative commons attribution 4 0 international license"]),
]
#: Wordings of a notice before its licence, which are all read as "under".
LEAD = "^(this (work|file|project|software|program|library|code|package) is )?(licensed|released|distributed|(made )?available) under "
#: Names that a tag carries for the "or later" licences.
_LATER = {"GPL-3.0-or-later": "gpl 3 0 or later", "GPL-2.0-or-later": "gpl 2 0 or later", "LGPL-3.0-or-later": "lgpl 3 0 or later",
          "LGPL-2.1-or-later": "lgpl 2 1 or later", "AGPL-3.0-or-later": "agpl 3 0 or later"}


def _spelt(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _families() -> list[tuple[str, str]]:
    """Notices, after their lead, and names that follow a tag."""
    notices = [(notice, f"under {wording}") for _, notice, wordings in NAMED for wording in wordings]
    tags = [(f"spdx-{name}", _spelt(name)) for name, *_ in NAMED]
    return notices + tags + [(f"spdx-{name}", spelt) for name, spelt in _LATER.items()]


SENTENCES += _families()
RULES = [
    ("MIT", ["mit-grant", "mit-notice-kept", "mit-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "later-than-3", "gpl-hope", "gpl-implied"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-hope", "gpl-implied"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "later-than-2", "gpl-hope", "gpl-implied"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "later-than-3"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "later-than-2"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "later-than-21"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl-terms", "later-than-3"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms", "gpl-hope", "gpl-implied"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms"]),
    ("MPL-2.0", ["mpl2-source"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-notice", "apache2-grant"]),
    *((name, ["spdx-tag", f"spdx-{name}"]) for name in [*_LATER, *(name for name, *_ in NAMED)]),
    *((name, [notice]) for name, notice, _ in NAMED),
    ("proprietary", ["all-rights"]),
]
#: Says little beside a licence: "All rights reserved." stands in many licence headers. It counts where nothing else is found.
WEAK = "proprietary"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Ends of sentences: where each line is apart, and where only blank lines and full stops part them.
CUTS = (r"\n|[.!?;:][ \t\n\f\r]+", r"\n[ \t\f\r]*\n|[.!?;:][ \t\n\f\r]+")


def normalised(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(sentence, _UPPER, _SMALL), "[^a-z0-9]+", " "))


def without_lead(sentence: Column) -> Column:
    """Notices begin with "under", however they are worded; other sentences stay."""
    return F.when(F.contains(sentence, F.lit(" under ")), F.regexp_replace(sentence, LEAD, "under ")).otherwise(sentence)


def _table(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("known"), F.lit(s).alias("sentence")) for k, s in known))
    return spark.range(1).select(F.inline(rows))


def scan(docs: DataFrame, known: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_sentences (known ones), ``sequence`` (their identifiers in order) and ``licences`` (sorted, distinct).

    ``known`` is a fixed list, so its table can be sent to every task; only rows of known sentences are shuffled.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).select(
        "id", "body", F.xxhash64("id", "body").alias("k1"), F.xxhash64("body", F.lit("licences"), "id").alias("k2"))
    # Each cut carries its number; the two lists are one column, so the text is read once.
    both = F.array(*(F.struct(F.lit(i).alias("cut"), F.split("body", c).alias("list")) for i, c in enumerate(CUTS)))
    every = rows.select("k1", "k2", F.explode(both).alias("c")).select("k1", "k2", "c.cut", F.posexplode("c.list").alias("at", "sentence"))
    every = every.withColumn("sentence", normalised(F.col("sentence"))).where("sentence <> ''")
    # Equal rows (same id and text) have equal keys: their sentences count once.
    every = every.withColumn("sentence", without_lead(F.col("sentence")))
    hits = every.join(F.broadcast(_table(docs.sparkSession, known)), "sentence").select("k1", "k2", "cut", "at", "known").distinct()
    steps = hits.groupBy("k1", "k2", "cut").agg(F.sort_array(F.collect_list(F.struct("at", "known")))["known"].alias("sequence"))
    steps = steps.withColumn("left", F.concat(F.lit(" "), F.array_join("sequence", "  "), F.lit(" ")))
    for i, (name, ids) in enumerate(rules):
        run = F.lit(f" {'  '.join(ids)} ")
        steps = steps.withColumn(f"r{i}", F.when(F.contains("left", run), F.lit(name)))
        # A mark keeps sentences that stood around a taken run apart.
        steps = steps.withColumn("left", F.replace("left", run, F.lit(" | ")))
    steps = steps.withColumn("licences", F.array_compact(F.array(*(f"r{i}" for i in range(len(rules))))))
    found = steps.groupBy("k1", "k2").agg(
        F.max_by("sequence", F.struct(F.size("sequence"), -F.col("cut"))).alias("sequence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("licences")))).alias("licences"))
    found = found.withColumn("licences", F.when(F.size("licences") > 1, F.array_remove("licences", WEAK)).otherwise(F.col("licences")))
    none = F.array().cast("array<string>")
    return rows.select("id", "k1", "k2").join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), F.coalesce(F.size("sequence"), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce("sequence", none).alias("sequence"), F.coalesce("licences", none).alias("licences"))


def oracle(known: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same for ``documents`` in DuckDB's SQL; it needs distinct ids."""
    table = ", ".join(f"('{k}', '{s}')" for k, s in known)
    cuts = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS cut, pos, l[pos] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos "
        f"FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{c}') AS l FROM documents))" for i, c in enumerate(CUTS))
    steps, last = [], "s"
    for i, (name, ids) in enumerate(rules):
        run = f"' {'  '.join(ids)} '"
        steps.append(f"t{i} AS (SELECT *, CASE WHEN contains(rest{i}, {run}) THEN '{name}' END AS r{i}, replace(rest{i}, {run}, ' | ') AS rest{i + 1} FROM {last})")
        last = f"t{i}"
    found = ", ".join(f"r{i}" for i in range(len(rules)))
    return f"""
WITH known(known, sentence) AS (VALUES {table}), every AS ({cuts}), hits AS (
  SELECT doc_id, cut, pos, known FROM (SELECT doc_id, cut, pos, regexp_replace(s, '{LEAD}', 'under ') AS sentence FROM (SELECT doc_id, cut, pos, trim(regexp_replace(translate(sentence, '{_UPPER}', '{_SMALL}'), '[^a-z0-9]+', ' ', 'g')) AS s
    FROM every)) JOIN known USING (sentence)
), s AS (SELECT doc_id, cut, list(known ORDER BY pos) AS sequence, ' ' || array_to_string(list(known ORDER BY pos), '  ') || ' ' AS rest0 FROM hits GROUP BY doc_id, cut
), {", ".join(steps)}, found AS (
  SELECT doc_id, arg_max(sequence, 2 * len(sequence) - cut) AS sequence,
    list_sort(list_distinct(flatten(list(list_filter([{found}], lambda x: x IS NOT NULL))))) AS every_licence FROM {last} GROUP BY doc_id
), strong AS (SELECT *, CASE WHEN len(every_licence) > 1 THEN list_filter(every_licence, lambda x: x <> '{WEAK}') ELSE every_licence END AS licences FROM found)
SELECT doc_id, CAST(coalesce(len(sequence), 0) AS BIGINT) AS n_sentences, coalesce(array_to_string(sequence, ','), '') AS sequence,
  coalesce(array_to_string(licences, ','), '') AS licences FROM documents LEFT JOIN strong USING (doc_id)"""
