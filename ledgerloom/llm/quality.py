"""Quality rules, line first: judge every line, remove what fails, reject documents that lose too much.

DataFrame expressions only, one pass over each row, no shuffle. A line is a piece between line
feeds; blank lines (no character outside the six ASCII white-space ones) are never judged.

Line rules, all by a line's form, so that they hold in any language but for the notices' words
* punctuation: marks such as ### or !! end 30 % of its words or more, or more than 10 % of its
  characters are symbols of ``[#*$%&|<>]``;
* navigation: 20 % of its words or more are bare separators, or it stands in a run of `RUN_LINES` lines
  or more of at most `SHORT_WORDS` words that end without punctuation (Unicode's, of any script), as menus do;
* boilerplate: it repeats an earlier line of its text of `REPEAT_WORDS` words or more, or it holds a
  notice of rights, licence, terms or consent (`NOTICES`: English, German, French, Spanish) for each
  `NOTICE_WORDS` of its words. A longer line that mentions one is text.

Documents are rejected if more than `most_lost` percent of the characters of their lines fail, or by
the base rules: fewer than `least_words` words, or more than half their words in repeated 3-word windows.

Nulls: a null text counts as empty and is rejected by its length; an empty table gives an empty one.
Extra columns stay as they are, whatever their names. Repeated rows are judged alike. Very long texts are
judged whole: window and line repeats are found by sorting, so the work is n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, bind, unused

NONBLANK = r"[^\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of marks at the end of a word.
MARKED = r"[#*$%&<>|~^=_!?]{2,}(?![^\x20\x09-\x0D])"
SEPARATOR = r"(?<![^\x20\x09-\x0D])[|>»•·/](?![^\x20\x09-\x0D])"
#: A line that ends without punctuation of any script.
OPEN_END = r"[^\x20\x09-\x0D\p{P}][\x20\x09-\x0D]*$"
RUN_LINES, SHORT_WORDS, REPEAT_WORDS = 3, 4, 4
#: Words of a notice by language; the first entry needs no language.
NOTICES = {
    "any": r"(?:©|\(c\))[\x20\x09-\x0D]*[0-9]{4}",
    "en": r"all rights reserved|(?:licensed|released) under|terms of (?:use|service)|privacy policy|(?:uses?|accept|enable) cookies|enable javascript|copyright [0-9]{4}",
    "de": r"alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutzerklärung|cookies (?:akzeptieren|zulassen)",
    "fr": r"tous droits réservés|sous licence|conditions d.utilisation|politique de confidentialité|accept(?:er|ez) les cookies",
    "es": r"todos los derechos reservados|bajo (?:la )?licencia|términos (?:de uso|del servicio)|política de privacidad|aceptar (?:las )?cookies",
}
NOTICE = "(?i)(?:" + "|".join(NOTICES.values()) + ")"
#: A notice makes up a line of so many words; a longer line that mentions one is text.
NOTICE_WORDS = 30


def line_failure(line: Column, words: Column, notice: str = NOTICE) -> Column:
    """Name of the rule that a non-blank line fails by itself, else null."""
    marked = F.regexp_count(line, F.lit(MARKED))
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    bare = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        F.when((100 * marked >= 30 * words) | (100 * symbols > 10 * F.length(line)), F.lit("punctuation"))
        .when(100 * bare >= 20 * words, F.lit("navigation"))
        .when(line.rlike(notice) & (words <= NOTICE_WORDS * F.regexp_count(line, F.lit(notice))), F.lit("boilerplate"))
    )


def judged_lines(text: Column, notice: str = NOTICE) -> Column:
    """array<struct(line, rule)> of all lines in order; rule is "blank", that of a failure, or null."""

    def alone(x: Column) -> Column:
        def row(w: Column) -> Column:
            rule = F.when(w == 0, F.lit("blank")).otherwise(line_failure(x, w, notice))
            return F.struct(x.alias("line"), rule.alias("rule"), w.alias("words"), ((w > 0) & (w <= SHORT_WORDS) & x.rlike(OPEN_END)).alias("short"))

        return bind(F.regexp_count(x, F.lit(WORD)), row)

    def repeats(rows: Column) -> Column:
        """For each line, is it equal to an earlier one? By sorting, and only where some line repeats."""
        long = lambda x: F.when(x["words"] >= REPEAT_WORDS, x["line"])
        keys = F.array_compact(F.transform(rows, long))
        ordered = F.array_sort(F.transform(rows, lambda x, i: F.struct(long(x).alias("line"), i.alias("i"))))
        again = lambda s: F.array_sort(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce(F.get(s, j - 1)["line"] == x["line"], F.lit(False)).alias("again"))))
        return bind(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), bind(ordered, again)))

    def together(rows: Column) -> Column:
        short = lambda i: F.coalesce(F.get(rows, i)["short"], F.lit(False))
        in_run = lambda i: (short(i - 1) & (short(i - 2) | short(i + 1))) | (short(i + 1) & short(i + 2))
        rule = lambda x, i, again: F.coalesce(x["rule"], F.when(x["short"] & in_run(i), F.lit("navigation")), F.when(F.get(again, i)["again"], F.lit("boilerplate")))
        return bind(repeats(rows), lambda again: F.transform(rows, lambda x, i: F.struct(x["line"].alias("line"), rule(x, i, again).alias("rule"))))

    return bind(F.transform(F.split(text, "\n", -1), alone), together)


def split_words(text: Column) -> Column:
    """Words of a text, none for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS + "+"))


def repeated_window_words(words: Column, k: int = 3) -> Column:
    """Number of words inside k-word windows that occur twice or more, each word once."""

    def covered(h: Column) -> Column:
        def at_repeats(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-k).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"))
        return F.aggregate(bind(ordered, at_repeats), start, step, lambda a: a["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
        whole = F.slice(hashes, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return bind(whole, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return bind(words, count)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def with_verdict(docs: DataFrame, verdict: str, text: str = "text", most_lost: int = 50, least_words: int = 50, notice: str = NOTICE) -> DataFrame:
    """docs with a struct column `verdict` (a name that docs has not): COUNTS and the text that is left."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    v = F.col(verdict)
    out = docs.withColumn(verdict, F.struct(split_words(whole).alias("words"), judged_lines(whole, notice).alias("lines")))
    full = F.filter(v["lines"], lambda x: F.coalesce(x["rule"], F.lit("")) != "blank")
    left = F.filter(v["lines"], lambda x: F.coalesce(x["rule"], F.lit("blank")) == "blank")
    size = lambda rows, some: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.when(some(x), F.length(x["line"])).otherwise(0))
    distinct = lambda rows: F.size(rows) - F.size(F.array_distinct(F.transform(rows, lambda x: x["line"])))
    counts = F.struct(
        F.size(v["words"]).cast("long").alias("n_words"),
        F.length(F.regexp_replace(whole, WS + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(full, lambda rows: F.struct(distinct(rows).cast("long").alias("dup"), size(rows, lambda x: F.lit(True)).alias("chars"), size(rows, lambda x: x["rule"].isNull()).alias("stay"))).alias("lines"),
        repeated_window_words(v["words"]).alias("n_repeat_words"),
        F.array_join(F.transform(left, lambda x: x["line"]), "\n").alias("text_left"),
    )
    out = out.withColumn(verdict, counts)
    base = (v["n_words"] < least_words) | (100 * v["n_repeat_words"] > 50 * v["n_words"])
    kept = ~base & (100 * (v["lines"]["chars"] - v["lines"]["stay"]) <= most_lost * v["lines"]["chars"])
    plain = [v[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "text_left")]
    return out.withColumn(verdict, F.struct(*plain, v["lines"]["dup"].alias("n_dup_lines"), base.alias("base_failed"), kept.alias("kept")))


def judge(docs: DataFrame, most_lost: int = 50, least_words: int = 50) -> DataFrame:
    """One row for each row of docs: doc_id, its counts, base_failed and kept."""
    got = with_verdict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "verdict", "text", most_lost, least_words)
    return got.select("doc_id", *[F.col("verdict")[c].alias(c) for c in COUNTS])


def clean(docs: DataFrame, most_lost: int = 50, least_words: int = 50) -> DataFrame:
    """The documents that are kept, without the lines that failed; the columns of docs.

    n_chars, if docs has it, is set to the length of the text that is left.
    """
    verdict, kept = unused(docs, "verdict", "kept")
    got = with_verdict(docs, verdict, "text", most_lost, least_words)
    # a filter would be moved below the projection and evaluate the whole verdict anew for its test
    got = got.withColumn(kept, F.explode(F.filter(F.array(verdict), lambda x: x["kept"])))
    text = F.col(kept)["text_left"]
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return got.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
