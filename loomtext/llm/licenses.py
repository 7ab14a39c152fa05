"""License scans by diagonal voting (operator 3).

Every rolling hash of ``GRAM`` words of every document is joined with the positions that
the hash has in the license templates. A hit votes for its diagonal, the word offset of
the document less that of the template; diagonals of a document and template no more than
``MERGE`` apart (a word or two put in or left out) are merged, and merged ones that span more
diagonals than the template has words are split again. A group whose hits cover at least
``VOTES`` of the template's grams is a candidate.

Candidates are verified word by word: the longest common subsequence of the template and of
the words where it would lie, from the first diagonal to the end of the template on the last
one, must have at least ``COVER`` of the template's words.

The templates are few, so the join is a broadcast one while their table is below
``BROADCAST_ROWS``, and a shuffled one beyond; so are the candidates.

Defined results: a null or short text has no hit; a template of fewer words than a gram is
never found; templates that share words are found each on its own merits; repeated rows
count as one document where their doc_id is equal (of different texts of one doc_id the best
match counts), and rows with a null doc_id are left out; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, large, trimmed
from .decontaminate import lcs_length
from .kernel import grams, lowered, rows_of, slices, words

GRAM, MERGE, VOTES, COVER = 3, 3, 0.3, 0.6
BROADCAST_ROWS = 200_000
#: Notices of public licenses, as they are put into files.
TEMPLATES = {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def rolling(docs: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, at, h: all rolling word n-gram hashes of all documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for batch in batches:
            text, ids = large(batch, "text"), batch.column("doc_id").cast(pa.int64()).to_numpy()
            for a, b in slices(text, 2 << 20):
                h, first, _, _ = words(lowered(text.slice(a, b - a)))
                g, own = grams(h, first, n)
                row = rows_of(own)
                if len(g):
                    yield pa.record_batch([pa.array(ids[a:b][row]), pa.array((np.arange(len(g)) - own[row]).astype(np.int32)), pa.array(g.view(np.int64))], schema=schema)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(trimmed(run), "doc_id bigint, at int, h bigint")


def positions(templates: dict[str, str], n: int = GRAM) -> list[tuple[str, int, int, int]]:
    """(template, grams it has, position, hash)."""
    out = []
    for name, text in sorted(templates.items()):
        h, first, _, _ = words(lowered(pa.array([text], pa.large_string())))
        g = grams(h, first, n)[0].view(np.int64).tolist()
        out += [(name, len(g), i, x) for i, x in enumerate(g)]
    return out


def _matched(docs: DataFrame, found: DataFrame, templates: dict[str, str]) -> DataFrame:
    """The candidates with the words that they have in common with their template, in order."""
    known = {}
    for name, text in templates.items():
        known[name] = words(lowered(pa.array([text], pa.large_string())))[0].tolist()
    names = [*found.columns, "matched_words"]

    def run(batches):
        masks: dict[str, dict[int, int]] = {}
        for batch in batches:
            text = large(batch, "text")
            ids, first, last = batch.column("license").to_pylist(), batch.column("first").to_pylist(), batch.column("last").to_pylist()
            matched = []
            for a, b in slices(text, 2 << 20):
                h, begin, _, _ = words(lowered(text.slice(a, b - a)))
                for i in range(a, b):
                    own = known[ids[i]]
                    mask = masks.setdefault(ids[i], {})
                    if not mask:
                        for k, w in enumerate(own):
                            mask[w] = mask.get(w, 0) | 1 << k
                    lo, hi = int(begin[i - a]), int(begin[i - a + 1])
                    matched.append(lcs_length(mask, len(own), h[lo + max(0, first[i]) : min(hi, lo + last[i] + len(own))].tolist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(matched, pa.int32())], names=names)

    small = found.count() <= BROADCAST_ROWS
    both = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(found) if small else found, "doc_id").select(*found.columns, "text")
    return both.mapInArrow(trimmed(run), ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", matched_words int").groupBy(*found.columns).agg(F.max("matched_words").alias("matched_words"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, n: int = GRAM, merge: int = MERGE, votes: float = VOTES, cover: float = COVER) -> DataFrame:
    """doc_id, license, start_word, end_word (exclusive), votes, matched_words, coverage (of the template's words)."""
    templates = TEMPLATES if templates is None else templates
    rows = positions(templates, n)
    known = docs.sparkSession.createDataFrame(rows, "license string, n_grams int, place int, h bigint")
    hits = rolling(docs, n).join(F.broadcast(known) if len(rows) <= BROADCAST_ROWS else known, "h").select("doc_id", "license", "n_grams", "at", "place").distinct()
    diagonals = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    w = Window.partitionBy("doc_id", "license").orderBy("diagonal")
    # one row for each hit; hits of one diagonal have no gap between them
    merged = diagonals.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= merge, 0).otherwise(1)).withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words_ = F.col("n_grams") + (n - 1)
    split = F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy("doc_id", "license", "group"))) / words_)
    found = (
        merged.withColumn("split", split)
        .groupBy("doc_id", "license", "n_grams", "group", "split")
        .agg(F.min("at").alias("start_word"), (F.max("at") + n).alias("end_word"), F.count(F.lit(1)).alias("votes"), F.count_distinct("place").alias("covered"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
        .where(F.col("covered") >= votes * F.col("n_grams"))
        .select("doc_id", "license", "n_grams", "start_word", "end_word", "votes", "first", "last")
    )
    matched = _matched(docs, durable(found), templates).where(F.col("matched_words") >= cover * words_)
    return matched.select("doc_id", "license", "start_word", "end_word", "votes", "matched_words", F.round(F.col("matched_words") / words_, 6).alias("coverage"))


def _oracle() -> str:
    values = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))
    found = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH RECURSIVE t AS (SELECT license, {found('body')} AS w FROM (VALUES {values}) AS v(license, body)),
k AS (SELECT license, len(w) - {GRAM - 1} AS n_grams, p::INTEGER AS place, array_to_string(w[p + 1:p + {GRAM}], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - {GRAM - 1})) AS p FROM t)),
x AS MATERIALIZED (SELECT doc_id, {found('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT doc_id, p::INTEGER AS pos, array_to_string(w[p + 1:p + {GRAM}], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - {GRAM - 1})) AS p FROM x WHERE len(w) >= {GRAM})),
h AS (SELECT DISTINCT doc_id, license, n_grams, pos, place, pos - place AS diagonal FROM d JOIN k ON d.g = k.g),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, license ORDER BY diagonal, pos) <= {MERGE} THEN 0 ELSE 1 END AS fresh FROM h),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, license ORDER BY diagonal, pos) AS cluster FROM m),
y AS (SELECT *, (diagonal - min(diagonal) OVER (PARTITION BY doc_id, license, cluster)) // (n_grams + {GRAM - 1}) AS split FROM c),
f AS (SELECT doc_id, license, n_grams, cluster, split, min(pos)::INTEGER AS start_word, (max(pos) + {GRAM})::INTEGER AS end_word, count(*) AS votes, min(diagonal) AS head, max(diagonal) AS tail
  FROM y GROUP BY doc_id, license, n_grams, cluster, split HAVING count(DISTINCT place) >= {VOTES} * n_grams),
a AS MATERIALIZED (SELECT row_number() OVER () AS id, f.*, t.w AS mine, x.w[greatest(head, 0) + 1:tail + len(t.w)] AS theirs FROM f JOIN t ON f.license = t.license JOIN x ON f.doc_id = x.doc_id),
-- rows of the table of common subsequences, one for each word of the template
l(id, i, best) AS (
  SELECT id, 0, list_transform(range(len(theirs)), lambda j: 0::BIGINT) FROM a
  UNION ALL
  SELECT id, i + 1, list_transform(range(1, len(u) + 1), lambda j: list_max(u[1:j])) FROM (
    SELECT l.id, l.i, list_transform(range(1, len(theirs) + 1), lambda j: CASE WHEN theirs[j] = mine[i + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE best[j] END) AS u FROM l JOIN a ON l.id = a.id WHERE l.i < len(mine))),
z AS (SELECT doc_id, license, n_grams, cluster, split, start_word, end_word, votes, max(best[-1])::INTEGER AS matched_words FROM l JOIN a ON l.id = a.id WHERE l.i = len(mine) GROUP BY ALL)
SELECT doc_id, license, start_word, end_word, votes, matched_words, round(matched_words / (n_grams + {GRAM - 1}), 6) AS coverage FROM z WHERE matched_words >= {COVER} * (n_grams + {GRAM - 1})
"""


ORACLE = _oracle()
