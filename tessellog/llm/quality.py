"""Quality rules by line-first cleaning.

Every line with a word is judged by itself: by its punctuation (runs of symbols and double
exclamation marks among its words; a fragment of few words without an end mark), as navigation
(separators between short parts, links) and as boilerplate (an earlier line's repetition, or a line that is but
a known phrase).  Failing lines go; a document that loses too much of its words with them is rejected.
Whole-text rules come first: too few words, too many repeated three-word windows.

Only built-in expressions run and every figure is made inside its row, so there is
no shuffle and no key that could be hot.  Each distinct line is judged once; what the good ones do not
hold of the text's words is lost.  Repeated windows are found by sorting
the row's window hashes, so a very long text takes n log n time.

Null and empty texts have no words and fail the base rules.  Repeated rows are
judged alike; shares that equal a limit pass.  Extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Percent of the words that repeated windows may hold.
MAX_REPEATED = 50
#: Percent of the words that failing lines may hold.
MAX_LOST = 40
#: Percent of a line's words that may hold a symbol run, end with two exclamation marks, or be links.
MAX_MARKED_WORDS = 30
#: Separators that make a line of parts navigation, and how many words a part may have on average.
MIN_SEPARATORS, MAX_PART_WORDS = 3, 6
#: A line of fewer words is a fragment, unless it ends like a sentence.
MIN_LINE_WORDS = 4
#: A line of more words is no boilerplate phrase.
MAX_PHRASE_WORDS = 12
#: Whole-line phrases of sites, not of texts, in four languages; fixed values.
BOILERPLATE = [
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "skip to content", "javascript is disabled", "subscribe to our newsletter", "click here to", "read more", "sign in", "log in",
    "datenschutz", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "alle rechte vorbehalten", "zum inhalt springen", "newsletter abonnieren", "mehr lesen", "anmelden",
    "politique de confidentialité", "mentions légales", "conditions d'utilisation", "tous droits réservés", "aller au contenu", "en savoir plus", "lire la suite", "se connecter",
    "política de privacidad", "política de cookies", "aviso legal", "términos de uso", "todos los derechos reservados", "saltar al contenido", "leer más", "iniciar sesión",
]
WORD = r"[^\x20\x09-\x0D]+"
MARKED = r"[#*$%&|<>][#*$%&|<>]|!!"
SEPARATORS = r"[|•·»›]| / "
LINK = r"://|www\."
ENDED = r"[.!?…:;,\x22'”’»)\]。！？][\x20\x09-\x0D]*$"
PHRASE = rf"^[^a-zà-ÿ]*(?:{'|'.join(BOILERPLATE)})[^a-zà-ÿ]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once a row however often the body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeat_words(words: Column) -> Column:
    """How many of ``words`` lie in three-word windows that occur twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def repeated(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(in_order, covered))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), repeated)))


def fails(line: Column, n: Column) -> Column:
    """Whether a line rule removes ``line``, which has ``n`` words; costly counts are made only where their marks occur."""

    def share(mark: str) -> Column:
        marked = F.regexp_count(line, F.lit(rf"[^\x20\x09-\x0D]*(?:{mark})[^\x20\x09-\x0D]*"))
        return F.when(line.rlike(mark), marked * 100 > n * MAX_MARKED_WORDS).otherwise(False)

    bars = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = F.when(line.rlike(SEPARATORS), (bars >= MIN_SEPARATORS) & (bars * MAX_PART_WORDS >= n)).otherwise(False)
    fragment = F.when(n < MIN_LINE_WORDS, ~line.rlike(ENDED)).otherwise(False)
    phrase = F.when(n <= MAX_PHRASE_WORDS, F.lower(line).rlike(PHRASE)).otherwise(False)
    return F.when(fragment, True).when(phrase, True).when(share(MARKED), True).when(share(LINK), True).otherwise(navigation)


def good_words(lines: Column) -> Column:
    """Words in those of ``lines``, distinct and each with a word, that stay."""
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return F.aggregate(counted, F.lit(0), lambda acc, x: acc + F.when(fails(x["line"], x["n"]), 0).otherwise(x["n"]))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", "text").select(
        "doc_id",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).cast("long").alias("again"))).alias("w"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: let(F.array_distinct(x), lambda own: F.struct((F.size(x) - F.size(own)).cast("long").alias("dup"), good_words(own).cast("long").alias("good")))).alias("l"),
    )
    figures = counted.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.again").alias("n_repeat_words"),
        (F.col("w.n") - F.col("l.good")).alias("n_lost_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST * F.col("n_words"))
    return figures.withColumn("base_failed", failed).withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` whose failing and repeated lines are cut from ``text``; the other columns stay.

    Repetitions are found by sorting a text's lines.
    """

    def told(s: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            again = F.coalesce(F.get(s, j - 1)["line"] == x["line"], F.lit(False))
            n = F.regexp_count(x["line"], F.lit(WORD))
            stays = F.when(n == 0, True).when(again, False).otherwise(~fails(x["line"], n))
            return F.struct(x["i"].alias("i"), x["line"].alias("line"), stays.alias("stays"))

        return F.sort_array(F.transform(s, one))

    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    kept = F.filter(let(F.sort_array(numbered), told), lambda x: x["stays"])
    return docs.withColumn("text", F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def _marked(mark: str) -> str:
    return rf"len(regexp_extract_all(line, '[^\x20\x09-\x0D]*(?:{mark})[^\x20\x09-\x0D]*')) * 100 > n * {MAX_MARKED_WORDS}"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = rf"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, coalesce(text, '') AS t,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
words AS (SELECT row, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM split),
three AS (SELECT row, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
repeated AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) > 1 AS again FROM three WHERE c IS NOT NULL),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) WHERE again GROUP BY row),
line AS (SELECT row, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
counted AS (SELECT row, line, len(regexp_extract_all(line, '{WORD}')) AS n, row_number() OVER (PARTITION BY row, line ORDER BY i) > 1 AS again,
  len(regexp_extract_all(line, '{SEPARATORS}')) AS bars FROM line),
lost AS (SELECT row, sum(n) FILTER (again OR {_marked(MARKED)} OR {_marked(LINK)} OR (bars >= {MIN_SEPARATORS} AND bars * {MAX_PART_WORDS} >= n)
  OR (n < {MIN_LINE_WORDS} AND NOT regexp_matches(line, '{_quoted(ENDED)}')) OR (n <= {MAX_PHRASE_WORDS} AND regexp_matches(lower(line), '{_quoted(PHRASE)}'))) AS n FROM counted GROUP BY row),
figures AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM split LEFT JOIN covered USING (row) LEFT JOIN lost USING (row)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {MAX_LOST} * n_words AS kept FROM failed
"""
