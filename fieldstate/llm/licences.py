"""Licence scans by sentence rules: known sentences become identifiers, ordered rules match the identifier sequences.

Row-local and built-in: a text is cut into sentences, each is normalised and looked up in a fixed table, and rules are
matched on the few sentences that are known. No shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences in normal form (lower case, letters and digits, single spaces) and their identifiers.
SENTENCES = {
    "mit-named": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-named": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-named": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl3-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose",
    "ccbync-named": "licensed under cc by nc 4 0",
    "ccby-named": "licensed under cc by 4 0",
    "bsd-forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer",
}
#: Fixed values: (rule, licence, identifiers in order).
RULES = (
    ("mit-named", "MIT", ("mit-named",)),
    ("mit-under", "MIT", ("mit-under",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is")),
    ("apache-named", "Apache-2.0", ("apache-named",)),
    ("apache-text", "Apache-2.0", ("apache-header", "apache-copy")),
    ("gpl3-named", "GPL-3.0", ("gpl3-named",)),
    ("gpl3-text", "GPL-3.0", ("gpl3-free", "gpl3-hope")),
    ("ccbync-named", "CC-BY-NC-4.0", ("ccbync-named",)),
    ("ccby-named", "CC-BY-4.0", ("ccby-named",)),
    ("bsd-text", "BSD", ("bsd-forms", "bsd-source")),
)
#: Greatest step, in sentences, between neighbours of a rule.
GAP = 4
#: Each known sentence holds one of these, so a text without them holds none of the sentences.
MARKS = ("licens", "permi", "warrant", "redistribut")


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, rule, licence, first_sentence, last_sentence): every place from which a rule's sentences follow in order.

    Sentences end at line ends and after ., ! or ? before white space; those without letters or digits do not count, and the
    others are numbered from 0. From each occurrence of a rule's first sentence, each further one is the nearest within GAP
    sentences. Null and empty texts match nothing; repeated rows and ids match each for themselves; a null id stays null. An
    empty table gives no rows. Other columns are left out.
    """
    table = "map(" + ", ".join(f"'{s}', '{k}'" for k, s in SENTENCES.items()) + ")"
    known = ", ".join(f"'{s}'" for s in SENTENCES.values())
    cut = r"split(regexp_replace(_t, '([.!?])[\\x20\\x09-\\x0D]+', '$1\n'), '\n', -1)"
    normal = r"trim(regexp_replace(lower(s), '[^a-z0-9]+', ' '))"
    found = (
        docs.select(F.col(id_col), F.col(text_col).alias("_t"))
        .filter(F.lower("_t").rlike("|".join(MARKS)))
        .withColumn("_s", F.expr(f"filter(transform({cut}, s -> {normal}), s -> s <> '')"))
        .withColumn("_f", F.expr(
            f"filter(transform(_s, (s, i) -> named_struct('at', i, 'sid', CASE WHEN s IN ({known}) THEN {table}[s] END)), x -> x.sid IS NOT NULL)"))
        .filter(F.size("_f") > 0)
    )
    matches = []
    for rule, licence, ids in RULES:
        rest = ", ".join(f"'{i}'" for i in ids[1:])
        step = (
            f"aggregate(array({rest}), x.at, (last, want) -> array_min(transform(filter(_f, y -> y.sid = want AND y.at > last "
            f"AND y.at <= last + {GAP}), y -> y.at)))" if rest else "x.at"
        )
        matches.append(
            f"transform(filter(_f, x -> x.sid = '{ids[0]}'), x -> named_struct('rule', '{rule}', 'licence', '{licence}', "
            f"'first_sentence', cast(x.at as long), 'last_sentence', cast({step} as long)))"
        )
    rows = found.withColumn("m", F.explode(F.expr(f"concat({', '.join(matches)})"))).filter("m.last_sentence IS NOT NULL")
    return rows.select(id_col, "m.*")


def sql(table: str = "documents") -> str:
    """The same result for DuckDB."""
    known = ", ".join(f"('{k}', '{s}')" for k, s in SENTENCES.items())
    parts = []
    for rule, licence, ids in RULES:
        joins, last = "", "f0.pos"
        for k, i in enumerate(ids[1:], 1):
            joins += (
                f" JOIN LATERAL (SELECT min(pos) AS pos FROM f WHERE f.r = f0.r AND f.sid = '{i}' AND f.pos > {last} AND f.pos <= {last} + {GAP}) f{k} ON true"
            )
            last = f"f{k}.pos"
        parts.append(
            f"SELECT f0.doc_id, '{rule}' AS rule, '{licence}' AS licence, f0.pos AS first_sentence, {last} AS last_sentence "
            f"FROM f f0{joins} WHERE f0.sid = '{ids[0]}' AND {last} IS NOT NULL"
        )
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table} WHERE regexp_matches(lower(text), '{'|'.join(MARKS)}')),
s AS (SELECT r, doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM t),
e AS (SELECT r, doc_id, unnest(s) AS s, CAST(unnest(range(len(s))) AS BIGINT) AS pos FROM s),
f AS (SELECT r, doc_id, pos, sid FROM e JOIN (VALUES {known}) AS k(sid, s) USING (s))
{' UNION ALL '.join(parts)}"""
