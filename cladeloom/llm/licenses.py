"""Licence scan: sparse TF-IDF cosine of the sentences of files to licence templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SIMILARITY = 0.65

# The usual short notices of licences.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|unlicense)(?:$|[.\-_])"


class Model:
    """TF-IDF weights of the templates: a term counts once in a sentence, and rare terms among the templates weigh more.

    A word that no template has weighs as much as the rarest term could.
    """

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        self.terms = [sorted(set(re.findall(r"[^\W_]+", t.lower()))) for _, t in templates]
        n = len(templates)
        df: dict[str, int] = {}
        for ts in self.terms:
            for t in ts:
                df[t] = df.get(t, 0) + 1
        self.square = {t: (math.log((1 + n) / (1 + d)) + 1) ** 2 for t, d in sorted(df.items())}
        self.unknown = (math.log(1 + n) + 1) ** 2
        self.norm = [math.sqrt(sum(self.square[t] for t in ts)) for ts in self.terms]


def _sentences(text: Column) -> Column:
    """Lines, parted again after sentence ends."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+")


def best_template(text: Column, model: Model, similarity: float = SIMILARITY) -> Column:
    """The struct (similarity, name) of the template most like any sentence of the text (ties: the later name), null if none is
    similar enough.

    A sentence in which the template terms are too small a share of the words cannot reach the similarity and is left out:
    the cosine is at most the root of that share.
    """
    vocabulary = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in model.square.items()])
    words = F.transform(_sentences(text), lambda s: F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    words = F.filter(words, lambda ws: (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: w.isin(list(model.square)))) >= similarity**2 * F.size(ws) - 1e-9))

    def scores(ws: Column) -> Column:
        known = F.filter(vocabulary, lambda v: F.array_contains(ws, v["t"]))
        norm = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, v: a + v["w"]) + (F.size(ws) - F.size(known)) * F.lit(model.unknown))
        each = [
            F.struct(
                F.round(F.aggregate(F.filter(known, lambda v: v["t"].isin(ts)), F.lit(0.0), lambda a, v: a + v["w"]) / (norm * F.lit(size)), 6).alias("similarity"),  # noqa: B023
                F.lit(name).alias("name"),
            )
            for name, ts, size in zip(model.names, model.terms, model.norm, strict=True)
        ]
        return F.array_max(F.array(*each))

    best = F.array_max(F.transform(words, scores))
    return F.when(best["similarity"] >= similarity, best)


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of (file_id, path, text) with own_license and own_similarity, license, origin and from_path.

    origin is `own` where a sentence of the file itself is like a template; else `inherited`, from the licence file in the
    nearest directory on the way up, its own first; else `none`. Of several licence files in a directory the most
    similar one counts (ties: the later licence name, then the later path). Directories, not files, are joined to their
    ancestors. A null or empty text has no own licence; a null path inherits none; repeated rows stay rows.
    """
    model = Model(templates)
    path = F.col("path").cast("string")
    found = files.select(F.col("file_id"), path.alias("path"), best_template(F.col("text").cast("string"), model, similarity).alias("own"))
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))
    found = written(found.withColumn("folder", folder), "licences")  # texts are scanned once
    given = found.where("own is not null").where(F.substring_index("path", "/", -1).rlike(LICENCE_FILE))
    given = given.groupBy("folder").agg(F.max(F.struct("own.similarity", "own.name", "path")).alias("given"))
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    up = F.concat(F.when(F.col("folder") != "", up).otherwise(F.slice(up, 1, 0)), F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))))
    folders = found.select("folder").where("folder is not null").distinct().select("folder", F.inline(up))
    nearest = folders.join(given.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))
    out = found.join(nearest, "folder", "left")
    return out.select(
        "file_id",
        "path",
        F.col("own.name").alias("own_license"),
        F.col("own.similarity").alias("own_similarity"),
        F.coalesce("own.name", "given.name").alias("license"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("given.path")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, as they carry no path: source/lang/hundred/doc_id.txt, where every hundredth document is the LICENSE of
    its directory, every thousandth of its language and every ten-thousandth of its source."""
    i = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.lit("LICENSE"))
    lang = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    folder = F.concat(lang, F.lit("/"), F.floor(i / 100).cast("string"))
    path = F.when(i % 10000 == 0, F.concat(top, F.lit("-"), i.cast("string"))).when(i % 1000 == 0, F.concat(lang, F.lit("/LICENSE-"), i.cast("string")))
    return docs.select(i.alias("file_id"), path.when(i % 100 == 0, F.concat(folder, F.lit("/LICENSE"))).otherwise(F.concat(folder, F.lit("/"), i.cast("string"), F.lit(".txt"))).alias("path"), "text")


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(document_files(docs)).withColumnRenamed("file_id", "doc_id")


def sql(templates: list[tuple[str, str]] = TEMPLATES, similarity: float = SIMILARITY) -> str:
    """The scan of `documents` in DuckDB's SQL."""
    m = Model(templates)
    weights = ", ".join(f"('{t}', {w!r})" for t, w in m.square.items())
    terms = ", ".join(f"('{n}', '{t}', {size!r})" for n, ts, size in zip(m.names, m.terms, m.norm, strict=True) for t in ts)
    return f"""
WITH w(t, w) AS (VALUES {weights}), tt(name, t, size) AS (VALUES {terms}),
files AS (
  SELECT doc_id, text, CASE
    WHEN doc_id % 10000 = 0 THEN coalesce(source, 'none') || '/LICENSE-' || doc_id
    WHEN doc_id % 1000 = 0 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/LICENSE-' || doc_id
    WHEN doc_id % 100 = 0 THEN coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) || '/LICENSE'
    ELSE coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path
  FROM documents),
units AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM files),
numbered AS (SELECT row_number() OVER () AS u, doc_id, list_distinct(regexp_extract_all(lower(s), '[\\pL\\pN]+')) AS ws FROM units),
words AS (SELECT u, doc_id, len(ws) AS n, unnest(ws) AS t FROM numbered WHERE len(ws) > 0),
known AS (SELECT u, doc_id, n, words.t, w.w FROM words JOIN w ON words.t = w.t),
norms AS (SELECT u, doc_id, sqrt(sum(w) + (any_value(n) - count(*)) * {m.unknown!r}) AS norm FROM known GROUP BY ALL),
dots AS (SELECT known.u, name, any_value(size) AS size, sum(w) AS dot FROM known JOIN tt ON known.t = tt.t GROUP BY known.u, name),
sims AS (SELECT doc_id, name, round(dot / (norm * size), 6) AS sim FROM dots JOIN norms USING (u)),
own AS (SELECT doc_id, max(struct_pack(sim := sim, name := name)) AS o FROM sims WHERE sim >= {similarity} GROUP BY doc_id),
found AS (SELECT f.doc_id, f.path, o, regexp_replace(f.path, '/[^/]*$', '') AS folder, regexp_extract(f.path, '[^/]*$') AS file FROM files f LEFT JOIN own USING (doc_id)),
given AS (SELECT folder, max(struct_pack(sim := o.sim, name := o.name, path := path)) AS g FROM found
          WHERE o IS NOT NULL AND regexp_matches(file, '^(?i)(licen[cs]e|copying|unlicense)($|[.\\-_])') GROUP BY folder),
near AS (
  SELECT f.folder, arg_max(g, length(given.folder)) AS g FROM (SELECT DISTINCT folder FROM found) f
  JOIN given ON f.folder = given.folder OR starts_with(f.folder, given.folder || '/') GROUP BY f.folder)
SELECT doc_id, path, o.name AS own_license, o.sim AS own_similarity, coalesce(o.name, g.name) AS license,
  CASE WHEN o IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN o IS NULL THEN g.path END AS from_path
FROM found LEFT JOIN near USING (folder)"""
