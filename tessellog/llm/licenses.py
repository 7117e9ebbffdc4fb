"""License scans by a positional rare-token index.

Licence templates are short word sequences.  Over all documents the operator counts
in how many each template word occurs; a template's rarest words (highest inverse
document frequency) are its anchors, and the index lists every anchor's templates
and positions.  Each file's anchors are looked up, the postings are intersected by
relative position (file position minus template position), and the best offset's
share of the template's anchor weight is its score.  A template counts if its score
is ``MIN_SCORE`` or more and its mandatory phrases stand in the file.

Fixed phrases are counted besides, wherever their words stand consecutively.

Only built-in expressions run.  The first pass shuffles one row for each template
word and task; the second reads the texts again, keeps the few anchor places of each
file in a table in the shared folder, and works on that alone.  What is broadcast
or comes to the driver has the size of the template list.

Null and empty texts have no words, no labels and score 0.  Repeated rows are told
apart by a row number and judged alike.  A very long text is searched whole; extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .quality import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label; fixed values.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label, template words, mandatory phrases; fixed values, from the licences' customary notices.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["in no event will the authors be held liable"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "dedicated to the public domain under the creative commons zero license", ["creative commons zero"]),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["gnu free documentation license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
]
#: Anchors of a template at most.
ANCHORS = 5
#: Share of its anchors' weight that a template needs at one offset.
MIN_SCORE = 0.6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def places(words: Column, phrase: str) -> Column:
    """The word numbers, from 0, at which ``phrase`` starts."""
    parts = phrase.split(" ")

    def found(w: Column) -> Column:
        def here(i: Column) -> Column:
            out = F.get(w, i) == parts[0]
            for j, part in enumerate(parts[1:], 1):
                out = out & (F.get(w, i + j) == part)
            return out

        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)

    return let(words, lambda w: F.when(F.arrays_overlap(w, F.array(F.lit(parts[0]))) & F.arrays_overlap(w, F.array(F.lit(parts[-1]))), found(w)).otherwise(F.array().cast("array<int>")))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents and in how many of them each template word occurs."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    listed = F.array(*map(F.lit, vocabulary))
    # The empty word stands for the document itself.
    hits = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words_of(F.col("text")), listed))).alias("word"))
    counts = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.get("", 0), {w: counts.get(w, 0) for w in vocabulary}


def index(n_docs: int, frequencies: dict[str, int]) -> list[tuple[str, int, int, float]]:
    """Postings (word, template, position, weight) of each template's anchors; a template's weights sum to 1."""
    idf = {w: math.log((n_docs + 1) / (n + 1)) + 1 for w, n in frequencies.items()}
    out = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        places_of = defaultdict(list)
        for i, w in enumerate(text.split()):
            places_of[w].append(i)
        anchors = sorted(places_of, key=lambda w: (-idf[w], w))[:ANCHORS]
        total = sum(idf[w] for w in anchors)
        out += [(w, t, i, idf[w] / total) for w in anchors for i in places_of[w]]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    postings = index(*document_frequencies(docs))
    anchors = F.array(*[F.lit(w) for w in sorted({w for w, *_ in postings})])
    phrases = sorted({p for _, _, needed in TEMPLATES for p in needed})

    def per_row(w: Column) -> Column:
        spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda s: F.array_contains(anchors, s["word"]))
        any_hit = F.arrays_overlap(w, anchors)
        kept = F.when(any_hit, let(spaced(w), lambda s: F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(s, F.concat(F.lit(" "), p, F.lit(" "))))))
        return F.struct(
            F.size(w).alias("n"),
            F.when(any_hit, hits).alias("hits"),
            kept.alias("phrases"),
            *[places(w, p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)],
        )

    found = docs.select("doc_id", let(words_of(F.col("text")), per_row).alias("f")).withColumn("row", F.monotonically_increasing_id())
    ps = [F.col(f"f.p{k}") for k in range(len(PHRASES))]
    rows = written(
        found.select(
            "row",
            "doc_id",
            F.col("f.n").cast("long").alias("n_words"),
            F.col("f.hits").alias("hits"),
            F.col("f.phrases").alias("phrases"),
            F.size(F.concat(*ps)).cast("long").alias("n_base"),
            F.array_min(F.concat(*ps)).cast("long").alias("first_word"),
            F.array_max(F.concat(*ps)).cast("long").alias("last_word"),
            F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(ps, PHRASES, strict=True)])).alias("base"),
        ),
        "licence-rows",
    )
    table = spark.createDataFrame(postings, "word string, template int, position int, weight double")
    needed = spark.createDataFrame([(t, label, ps) for t, (label, _, ps) in enumerate(TEMPLATES)], "template int, label string, needed array<string>")
    votes = (
        rows.where("size(hits) > 0")
        .select("row", "phrases", F.explode("hits").alias("hit"))
        .select("row", "phrases", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
        .join(F.broadcast(table), "word")  # postings: the size of the template list
        .groupBy("row", "template", (F.col("at") - F.col("position")).alias("offset"))
        .agg(F.sum("weight").alias("score"), F.first("phrases").alias("phrases"))
        .where(F.col("score") >= MIN_SCORE)
        .join(F.broadcast(needed), "template")
        .where(F.size(F.array_except("needed", "phrases")) == 0)
        .groupBy("row")
        .agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.join(votes, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined("base").alias("base_labels"),
        joined(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
    )


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    templates = ", ".join(f"({t}, '{label}', {quoted(text.split())}, {quoted(needed)})" for t, (label, text, needed) in enumerate(TEMPLATES))
    phrase = lambda p: " AND ".join(f"{c} = '{w}'" for c, w in zip("abc", p.split()))
    found = " UNION ALL ".join(f"SELECT row, pos, '{label}' AS label FROM three WHERE {phrase(p)}" for p, label in PHRASES)
    return rf"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM split),
three AS (SELECT row, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY row ORDER BY pos)),
places AS ({found}),
based AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY row),
templates(t, label, words, needed) AS (VALUES {templates}),
tw AS (SELECT t, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS position FROM templates),
df AS (SELECT word, count(DISTINCT row) AS n FROM words WHERE word IN (SELECT word FROM tw) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM split) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
ranked AS (SELECT t, word, idf, row_number() OVER (PARTITION BY t ORDER BY idf DESC, word) AS nth FROM (SELECT DISTINCT t, word FROM tw) JOIN idf USING (word)),
weights AS (SELECT t, word, idf / sum(idf) OVER (PARTITION BY t) AS weight FROM ranked WHERE nth <= {ANCHORS}),
votes AS (SELECT row, t, pos - position AS shift, sum(weight) AS score FROM words JOIN (SELECT * FROM tw JOIN weights USING (t, word)) USING (word) GROUP BY ALL HAVING sum(weight) >= {MIN_SCORE}),
checked AS (SELECT v.row, v.score, x.label FROM votes v JOIN templates x USING (t) JOIN split s USING (row)
  WHERE len(list_filter(x.needed, lambda p: NOT contains(' ' || array_to_string(s.w, ' ') || ' ', ' ' || p || ' '))) = 0),
own AS (SELECT row, list(DISTINCT label) AS own, max(score) AS score FROM checked GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  round(least(coalesce(score, 0), 1), 6) AS score
FROM split LEFT JOIN based USING (row) LEFT JOIN own USING (row)
"""


SQL = _sql()
