"""Licence scan by sentence rules, in DataFrame functions.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` before white
space. Sentences are normalised (lower case, runs of anything but letters and digits to one
blank) and looked up among known licence sentences, which gives an identifier. The
identifiers of adjacent sentences form sequences; a licence rule is an ordered sequence of
identifiers and is found wherever its identifiers follow each other. A match inside a
larger match of the same document is left out; of equal spans the rule that stands first in
the table holds.

Only known sentences leave their row, so one narrow shuffle carries the few hits. Sentences
and rules are tables of a fixed size that the caller gives; they are broadcast. A document of
any length is scanned whole; its hits are joined by (document, position), never gathered
in one row.

Defined results: null and empty texts, and texts without known sentences, have no row.
Empty sentences do not count as positions. Rows that repeat a doc_id and text give their
matches once; null ids are scanned like others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concourse.llm.common import staged, whole_text

CUT = r"[.!?]\s+|[.!?]$|\n"

# Known sentences (identifier, normalised sentence) and rules (rule, licence, identifiers in
# order): the usual wording of licence notices, fixed values.
SENTENCES = [
    ("mit-notice", "released under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                  "and associated documentation files the software to deal in the software without restriction "
                  "including without limitation the rights to use copy modify merge publish distribute sublicense "
                  "and or sell copies of the software and to permit persons to whom the software is furnished to "
                  "do so subject to the following conditions"),
    ("mit-keep", "the above copyright notice and this permission notice shall be included in all copies or "
                 "substantial portions of the software"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "licensed under the apache license version 2 0 the license"),
    ("apache-terms", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("gpl3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the "
                 "gnu general public license as published by the free software foundation either version 3 of the "
                 "license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without "
                 "even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc-by-nc-4-notice", "licensed under cc by nc 4 0"),
    ("cc-by-4-notice", "licensed under cc by 4 0"),
    ("cc-by-sa-4-notice", "licensed under cc by sa 4 0"),
]
RULES = [
    ("mit-full", "MIT", ["mit-title", "mit-grant", "mit-keep"]),
    ("mit-grant-keep", "MIT", ["mit-grant", "mit-keep"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("apache-2-header", "Apache-2.0", ["apache-notice", "apache-terms", "apache-copy"]),
    ("apache-2-terms", "Apache-2.0", ["apache-notice", "apache-terms"]),
    ("apache-2-notice", "Apache-2.0", ["apache-notice"]),
    ("gpl-3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("gpl-3-free", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl-3-notice", "GPL-3.0-only", ["gpl3-notice"]),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("cc-by-4", "CC-BY-4.0", ["cc-by-4-notice"]),
    ("cc-by-sa-4", "CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
]


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """The text's normalised sentences, without empty ones."""
    return F.filter(F.transform(F.split(text, CUT), normalised), lambda s: s != "")


def sentence_table(spark: SparkSession, known=SENTENCES) -> DataFrame:
    return spark.createDataFrame(known, "sid string, sentence string")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, licence, priority, length, step, sid): a row per identifier of each rule."""
    rows = [(r, lic, p, len(ids), i, sid) for p, (r, lic, ids) in enumerate(rules) for i, sid in enumerate(ids)]
    return spark.createDataFrame(rows, "rule string, licence string, priority int, length int, step int, sid string")


def licence_sentences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, hash, at, sid): the known sentences of each text and their positions."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"),
                      F.posexplode(sentences(whole_text())).alias("at", "sentence"))
    return own.join(F.broadcast(known), "sentence").select("doc_id", "hash", "at", "sid").distinct()


def scan_licences(docs: DataFrame, known=SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, rule, licence, first_sentence, last_sentence) of every match."""
    spark = docs.sparkSession
    hits = staged(licence_sentences(docs, sentence_table(spark, known)), "sentences")
    # a hit as a step of a rule says where that rule would begin; a rule is there if all its
    # steps say the same place
    at = F.col("at") - F.col("step")
    key = ["doc_id", "hash", "first_sentence", "priority"]
    steps = (hits.join(F.broadcast(rule_table(spark, rules)), "sid")
             .groupBy("doc_id", "hash", at.alias("first_sentence"), "priority", "rule", "licence", "length")
             .agg(F.countDistinct("step").alias("steps")))
    found = staged(steps.filter("steps = length").withColumn(
        "last_sentence", (F.col("first_sentence") + F.col("length") - 1).cast("int"))
        .select(*key, "rule", "licence", "length", "last_sentence"), "matches")
    # a match spans fewer sentences than the longest rule, so one that holds it begins at most
    # that far before: an equi-join on (document, begin) finds it
    far = max((len(ids) for _, _, ids in rules), default=1)
    outer = found.select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("first_sentence").alias("_first"),
        F.col("last_sentence").alias("_last"), F.col("length").alias("_length"), F.col("priority").alias("_priority"),
        F.explode(F.sequence(F.lit(0), F.lit(far - 1))).alias("_shift"))
    outer = outer.withColumn("_at", F.col("_first") + F.col("_shift")).filter(F.col("_at") <= F.col("_last"))
    inside = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
        & (F.col("first_sentence") == F.col("_at")) & (F.col("last_sentence") <= F.col("_last"))
        & ((F.col("_length") > F.col("length"))
           | ((F.col("_length") == F.col("length")) & (F.col("_priority") < F.col("priority")))))
    return found.join(outer, inside, "left_anti").select(
        "doc_id", "rule", "licence", "first_sentence", "last_sentence")


def scan_sql(known=SENTENCES, rules=RULES) -> str:
    """The same scan of ``documents`` as DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sids = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known)
    rows = ", ".join(f"({quoted(r)}, {quoted(lic)}, {p}, [{', '.join(map(quoted, ids))}])"
                     for p, (r, lic, ids) in enumerate(rules))
    return f"""
WITH known(sid, sentence) AS (VALUES {sids}),
rules(rule, licence, priority, ids) AS (VALUES {rows}),
cut AS (
  SELECT doc_id, text, list_filter(list_transform(
      regexp_split_to_array(coalesce(text, ''), '[.!?]\\s+|[.!?]$|\\n'),
      lambda s: trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), lambda s: s <> '') AS list
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
each AS (SELECT doc_id, text, unnest(list) AS sentence, generate_subscripts(list, 1) - 1 AS pos FROM cut),
hits AS (SELECT doc_id, text, pos, sid FROM each JOIN known USING (sentence)),
starts AS (SELECT h.doc_id, h.text, h.pos AS begin_at, r.* FROM hits h JOIN rules r ON r.ids[1] = h.sid),
found AS (
  SELECT s.doc_id, s.text, s.rule, s.licence, s.priority, s.begin_at, s.begin_at + len(s.ids) - 1 AS end_at
  FROM starts s
  WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT unnest(s.ids) AS sid, generate_subscripts(s.ids, 1) - 1 AS step) w
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id IS NOT DISTINCT FROM s.doc_id
                      AND h.text IS NOT DISTINCT FROM s.text AND h.pos = s.begin_at + w.step AND h.sid = w.sid)))
SELECT f.doc_id, f.rule, f.licence, CAST(f.begin_at AS INTEGER) AS first_sentence, CAST(f.end_at AS INTEGER) AS last_sentence
FROM found f
WHERE NOT EXISTS (
  SELECT 1 FROM found o WHERE o.doc_id IS NOT DISTINCT FROM f.doc_id AND o.text IS NOT DISTINCT FROM f.text
    AND o.begin_at <= f.begin_at AND o.end_at >= f.end_at
    AND (o.end_at - o.begin_at > f.end_at - f.begin_at OR (o.end_at - o.begin_at = f.end_at - f.begin_at AND o.priority < f.priority)))
"""
