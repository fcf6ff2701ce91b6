"""License scans with a positional rare-token index.

Each template is a short run of words with a key phrase inside it. The index
holds, for each template, the postings (word, position) of its rarest words:
document frequencies are counted over all documents, so that "rarest" means
highest inverse document frequency in this corpus. The rarest words are taken
from the template's key phrase, so that any file that holds the phrase holds
them.

A file's words are looked up in the index. A word of the file at place i that
a template has at position p proposes that the template stands at i - p; the
proposals of a template's rare words are intersected. A place that is left
counts if the mandatory key phrase stands there in full. Its score is the
share of the template's idf weight found in place.

Base labels come from templates that are just the phrase, so every place where
the phrase's words stand consecutively is found. The longer templates add
labels of their own where at least ``MIN_SHARE`` of their weight is in place.

Null and empty texts have no words: counts zero, no labels, score zero, word
numbers null. Repeated rows are scanned alike. An empty table gives an empty
result. Texts are scanned whole where they lie; only counts of the few hundred
template words are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.llm.common import ascii_lower, or_empty, packed, table

#: ASCII letters and digits, and everything beyond ASCII (the text is not yet lower-cased)
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_SHARE = 0.7
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrase: str  # mandatory; stands inside ``words``
    base: bool = False


#: fixed values: base phrases and their labels
BASE = [
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
]
#: fixed values: openings of well-known licence texts and notices
MORE = [
    Template("gpl-3", "gnu general public license version 3", "public license version 3"),
    Template("gpl-2", "gnu general public license version 2", "public license version 2"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify"),
    Template("cc-by", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(or_empty(text), F.lit(TOKEN), F.lit(0))


def idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Word arrays ``w`` -> idf of each word of the vocabulary, over all rows. The result has one row a word."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    total = F.struct(F.lit(None).cast("string").alias("word"), F.lit(1).alias("one"))
    each = F.transform(F.array_intersect(F.col("w"), known), lambda w: F.struct(w.alias("word"), F.lit(1).alias("one")))
    counts = {r["word"]: r["n"] for r in words.select(F.explode(F.concat(F.array(total), each)).alias("x"))
              .groupBy("x.word").agg(F.sum("x.one").alias("n")).collect()}
    n = counts.get(None, 0)
    return {w: math.log((n + 1.0) / (counts.get(w, 0) + 0.5)) for w in vocabulary}


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


def postings(templates: list[Template], weight: dict[str, float]) -> list[dict]:
    """The index: of each template, the ``ANCHORS`` highest-idf words of its key
    phrase with their positions in the template."""
    rows = []
    for t in templates:
        words, phrase = t.words.split(), t.phrase.split()
        inside = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
        rare = sorted(set(phrase), key=lambda w: (-weight[w], w))[:ANCHORS]
        rows.append({"label": t.label, "base": t.base, "words": words, "phrase": phrase, "inside": inside,
                     "anchors": [(w, inside + phrase.index(w)) for w in rare], "weight": [weight[w] for w in words]})
    return rows


def with_matches(files: DataFrame, templates: list[Template], weight: dict[str, float]) -> DataFrame:
    """A frame with lower-cased words ``w`` -> adds ``found``: an array of
    struct(base, label, start, share), one for each verified place of each
    template; null where no indexed word occurs."""
    index = postings(templates, weight)
    rare = sorted({w for t in index for w, _ in t["anchors"]})
    files = files.withColumn("places", F.when(F.arrays_overlap("w", F.array(*[F.lit(a) for a in rare])), F.filter(
        F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))),
        lambda x: x["word"].isin(rare))))
    word_at = lambda i: F.get("w", i)

    def matches(t: dict) -> Column:
        proposed = lambda w, at: F.transform(F.filter("places", lambda x: x["word"] == w), lambda x: x["i"] - at)
        starts = reduce(F.array_intersect, [proposed(w, at) for w, at in t["anchors"]])
        stands = lambda s: reduce(lambda a, b: a & b, [
            F.coalesce(word_at(s + (t["inside"] + k)) == w, F.lit(False)) for k, w in enumerate(t["phrase"])])
        share = lambda s: reduce(lambda a, b: a + b, [
            F.when(word_at(s + k) == w, x).otherwise(0.0) for k, (w, x) in enumerate(zip(t["words"], t["weight"]))]) / sum(t["weight"])
        hits = F.transform(F.filter(starts, stands), lambda s: F.struct(
            F.lit(t["base"]).alias("base"), F.lit(t["label"]).alias("label"), s.cast("long").alias("start"), share(s).alias("share")))
        return F.filter(hits, lambda h: h["base"] | (h["share"] >= MIN_SHARE))

    return files.withColumn("found", F.when(F.col("places").isNotNull(), F.concat(*[matches(t) for t in index]))).drop("places")


def scan(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """``row`` (the input's columns but the text) and n_words, n_base,
    first_word, last_word, base_labels, labels, score."""
    templates = BASE + MORE if templates is None else templates
    t = docs[f"`{text}`"]
    known = vocabulary(templates)
    weight = idf(docs.select(words_of(ascii_lower(t)).alias("w")), known)
    files = packed(docs, t.alias("t"), keep=[c for c in docs.columns if c != text])
    files = files.select("row", words_of(ascii_lower(F.col("t"))).alias("w"))
    hits = with_matches(files, templates, weight).select("row", F.size("w").cast("long").alias("n_words"), "found")
    base = F.filter("found", lambda h: h["base"])
    labels = lambda xs: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda h: h["label"]))), ","), F.lit(""))
    return hits.select(
        "row", "n_words", F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda h: h["share"])), F.lit(0.0)), 6).alias("score"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                             "base_labels", "labels", "score")


def _sql() -> str:
    """The same scan by plain search: every template at every place."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    values = ",\n  ".join(
        f"({t.base}, '{t.label}', {quoted(t.words.split())}, {quoted(t.phrase.split())}, "
        f"{len(t.words[:t.words.index(t.phrase)].split())})" for t in BASE + MORE)
    return f"""
WITH t(base, label, words, phrase, inside) AS (VALUES
  {values}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
known AS (SELECT DISTINCT unnest(words) AS word FROM t),
df AS (SELECT k.word, count(s.word) AS n FROM known k LEFT JOIN (SELECT unnest(list_distinct(w)) AS word FROM d) s ON k.word = s.word GROUP BY k.word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1.0) / (n + 0.5)) AS x FROM df),
tw AS (
  SELECT base, label, words, phrase, inside, list(x ORDER BY i) AS weight
  FROM (SELECT base, label, words, phrase, inside, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t) JOIN idf USING (word)
  GROUP BY ALL),
places AS (
  SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE list_has_any(w, (SELECT list(phrase[1]) FROM t))),
hits AS (
  SELECT doc_id, base, label, i - 1 - inside AS start,
         list_sum(list_transform(range(len(words)), lambda k: CASE WHEN i - inside + k >= 1 AND w[i - inside + k] = words[k + 1] THEN weight[k + 1] ELSE 0.0 END))
           / list_sum(weight) AS share
  FROM places JOIN tw ON places.word = phrase[1] AND list_slice(w, i, i + len(phrase) - 1) = phrase),
kept AS (SELECT * FROM hits WHERE base OR share >= {MIN_SHARE}),
per AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN per USING (doc_id)
"""


OP6_SQL = _sql()
