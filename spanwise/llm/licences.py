"""Operator 6: licence scan by sentence rules.

Texts are cut into sentences and normalised; sentences known from licence notices become identifiers. Full sentences of
licence texts are also found inside and across what the cutting leaves, so wraps and comment marks don't hide them; the
sequence of a text's identifiers is then matched against ordered rules, longer ones first, and what a rule
matched can't be matched again. Everything is a DataFrame expression over one row; nothing is shuffled.

Defined cases: a null or empty text has no sentences and no licence; repeated rows are scanned row by row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import let, spread, table

#: Normalised sentences of licence notices and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-short",
    'licensed under the apache license version 2 0 the license': "apache-notice",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "spdx license identifier apache 2 0": "apache-spdx",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "spdx license identifier mit": "mit-spdx",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "this program is free software you can redistribute it and or modify it": "gpl-free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "spdx license identifier gpl 3 0 only": "gpl3-spdx",
    "licensed under cc by nc 4 0": "ccbync-short",
    "licensed under cc by 4 0": "ccby-short",
    "licensed under cc by sa 4 0": "ccbysa-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby-long",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd-name",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: Full normalised sentences of licence texts; ``*`` stands for up to 12 words, such as a holder's name.
FULL = [
    ("licensed under the apache license version 2 0 the license", "apache-notice"),
    ("you may not use this file except in compliance with the license", "apache-comply"),
    ("you may obtain a copy of the license at", "apache-copy"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit-grant"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-condition"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-warranty"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-free"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl3-free"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-hope"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "ccby-long"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-grant"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-source"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-binary"),
    ("neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-name"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Licences and the sentence identifiers that name them, in order; earlier rules go first.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-spdx"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-spdx"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl3-spdx"]),
    ("GPL-2.0", ["gpl2-short"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]),
    ("CC-BY-SA-4.0", ["ccbysa-short"]),
    ("CC-BY-4.0", ["ccby-short"]),
    ("CC-BY-4.0", ["ccby-long"]),
    ("Unlicense", ["unlicense"]),
]

#: A line that goes on in lower case belongs to the sentence of the line before.
WRAP = r"\n([a-z])"
#: Sentences end at a line end, or at a full stop, mark or bracketed list item followed by white space.
END = r"\n+|[.!?:;]+(?:[\x20\x09\x0D]+|\n|$)"
NOT_WORD = r"[^a-z0-9]+"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text: words of lower-case letters and digits, single spaces between."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WRAP, " $1"), r"\r", " ")
    parts = F.transform(F.split(joined, END), lambda s: F.trim(F.regexp_replace(F.lower(s), NOT_WORD, " ")))
    return F.filter(parts, lambda s: s != "")


def pattern(sentence: str) -> str:
    """A full sentence between words, whichever of its gaps (blanks, or bars between parts) it has."""
    return r"(?<=\|| )" + sentence.replace("* ", "(?:[a-z0-9]+[ |]){1,12}?").replace(" ", "[ |]") + r"(?=\|| )"


def marked(parts: Column) -> Column:
    """``parts`` with each full sentence, wherever it begins and ends, as a part of its own: its identifier behind an at sign."""
    flow = F.concat(F.lit("|"), F.array_join(parts, "|"), F.lit("|"))
    out = flow
    for sentence, name in FULL:
        out = F.regexp_replace(out, pattern(sentence), f"|@{name}|")
    # Most texts have none of the words that every full sentence has one of.
    hint = flow.rlike("licen[sc]e|redistribution|permission|warrant|unencumbered")
    return F.when(hint, F.transform(F.split(out, r"\|"), lambda s: F.trim(s))).otherwise(parts)


def identifiers(parts: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in [*SENTENCES.items(), *{f"@{i}": i for _, i in FULL}.items()] for x in pair])
    return F.filter(F.transform(marked(parts), lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids (comma-joined), licences (comma-joined, in the rules' order) and n_matches."""
    parts = let(sentences(F.col("text")), lambda s: F.struct(F.size(s).cast("long").alias("n"), F.array_join(identifiers(s), ",").alias("ids")))
    df = docs.select("doc_id", parts.alias("s")).select("doc_id", F.col("s.n").alias("n_sentences"), F.col("s.ids").alias("sentence_ids"))
    # Each identifier stands between marks of its own, so a rule is a plain substring and its matches can be struck out.
    df = df.withColumn("_seq", F.when(F.col("sentence_ids") == "", "").otherwise(F.concat(F.lit("<"), F.replace("sentence_ids", F.lit(","), F.lit("><")), F.lit(">"))))
    for k, (_, ids) in enumerate(RULES):
        rule, hit = "".join(f"<{x}>" for x in ids), f"<{'*' * len(ids)}#{k}>"
        df = df.withColumn("_seq", F.replace("_seq", F.lit(rule), F.lit(hit)))
    names = list(dict.fromkeys(x for x, _ in RULES))
    found = [F.when(_any(F.col("_seq"), [k for k, (x, _) in enumerate(RULES) if x == name]), name) for name in names]
    hits = F.length(F.regexp_replace("_seq", r"[^#]", "")).cast("long")
    return df.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_compact(F.array(*found)), ",").alias("licences"), hits.alias("n_matches"))


def _any(seq: Column, rules: list[int]) -> Column:
    out = F.lit(False)
    for k in rules:
        out = out | F.contains(seq, F.lit(f"#{k}>"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in [*SENTENCES.items(), *{f"@{i}": i for _, i in FULL}.items()])
    flow = "flow"
    for sentence, name in FULL:
        gaps = sentence.replace("* ", "(?:[a-z0-9]+[ |]){1,12}?").replace(" ", "[ |]")
        # Without look-around a match takes its delimiters; of neighbours that share one, the second time finds the rest.
        for _ in range(2):
            flow = rf"regexp_replace({flow}, '([| ]){gaps}([| ])', '\1|@{name}|\2', 'g')"
    seq = "'<' || replace(sentence_ids, ',', '><') || '>'"
    for k, (_, ids) in enumerate(RULES):
        seq = f"replace({seq}, '{''.join(f'<{x}>' for x in ids)}', '<{'*' * len(ids)}#{k}>')"
    names = list(dict.fromkeys(x for x, _ in RULES))
    case = ", ".join("CASE WHEN " + " OR ".join(f"contains(seq, '#{k}>')" for k, (x, _) in enumerate(RULES) if x == n) + f" THEN '{n}' END" for n in names)
    return rf"""
WITH part AS (
  SELECT doc_id, list_filter(list_transform(
           string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '\n([a-z])', ' \1', 'g'), '\r', ' ', 'g'),
                              '\n+|[.!?:;]+(?:[\x20\x09\x0D]+|\n|$)'),
           lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s
  FROM documents),
known(sentence, id) AS (VALUES {known}),
joined AS (SELECT doc_id, s, '|' || array_to_string(s, '|') || '|' AS flow FROM part),
told AS (
  SELECT doc_id, CASE WHEN regexp_matches(flow, 'licen[sc]e|redistribution|permission|warrant|unencumbered')
                 THEN list_transform(string_split({flow}, '|'), lambda x: trim(x)) ELSE s END AS s FROM joined),
one AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS p FROM told),
ids AS (SELECT doc_id, string_agg(id, ',' ORDER BY p) AS sentence_ids FROM one JOIN known USING (sentence) GROUP BY doc_id),
every AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids FROM part LEFT JOIN ids USING (doc_id)),
struck AS (SELECT *, {seq} AS seq FROM every)
SELECT doc_id, n_sentences, sentence_ids, concat_ws(',', {case}) AS licences,
       CAST(length(seq) - length(replace(seq, '#', '')) AS BIGINT) AS n_matches
FROM struck
"""


ORACLE = _oracle()
