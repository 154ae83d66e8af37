"""Line dedup by spread over distinct sites.

Method. Every line's hash gets a HyperLogLog sketch of the sites it occurs on; the sketches merge by
aggregation. A line far above the threshold is boilerplate by its estimate; one whose estimate is
within `band` of the threshold gets an exact count of distinct sites. Lines on `least_sites` sites or
more are boilerplate and leave every document. The site is the `source` column.

Scale. Only hashes and sites are shuffled, aggregated before the exchange, so a line of a third of
all rows is one row for each task. Lines meet the few that are wide without a shuffle while those are at
most `MOST_BROADCAST`, by count; beyond that the wide lines are written once for each of `SALTS` salts and
lines are dealt by hash and salt, so that no line's occurrences go to one task. What is removed is a
function of the text alone, so documents get their line numbers back by the 128-bit hash of their text.

Nulls and edges: null text counts as having no lines and stays null; a null source counts as no
site; lines are compared without white space at their ends; blank lines are no lines and stay.
Repeated rows are treated alike; a text of any length is searched whole; an empty table gives an empty
one. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, materialize, unused

LG_K = 10
#: Relative half-width of the band around the threshold in which counts are exact (over 6 sigma at LG_K 10).
BAND = 0.25
#: Lines (two hashes each) that may be broadcast, and copies of each beyond that.
MOST_BROADCAST, SALTS = 300_000, 32


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _lines(docs: DataFrame, least_words: int = 0) -> DataFrame:
    """(k1, k2, site, pos, h1, h2) for every non-blank line, of least_words words or more."""
    cut = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)))
    k1, k2 = _keys(F.col("text"))
    rows = docs.where("text is not null").select(k1.alias("k1"), k2.alias("k2"), F.col("source").cast("string").alias("site"), F.posexplode(cut).alias("pos", "line"))
    rows = rows.where("line != ''")
    if least_words > 1:
        rows = rows.where(F.regexp_count("line", F.lit(WS + "+")) >= least_words - 1)
    h1, h2 = _keys(F.col("line"))
    return rows.select("k1", "k2", "site", "pos", h1.alias("h1"), h2.alias("h2"))


def _among(lines: DataFrame, few: DataFrame) -> DataFrame:
    """The lines that few (h1, h2; a written table of distinct lines) has."""
    if few.count() <= MOST_BROADCAST:
        return lines.join(F.broadcast(few.select("h1", "h2")), ["h1", "h2"], "left_semi")
    salted = few.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"], "left_semi").drop("salt")


def line_spread(docs: DataFrame, least_sites: int = 10, band: float = BAND, least_words: int = 0) -> DataFrame:
    """(h1, h2, sites, exact) of the lines that may be on least_sites sites: the estimated number of sites,
    or within the band around least_sites the exact one."""
    lines = _lines(docs, least_words).where("site is not null")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    wide = materialize(sketched.where(F.col("sites") >= (1 - band) * least_sites), "wide_lines")
    far = F.col("sites") > (1 + band) * least_sites
    counted = _among(lines, wide.where(~far)).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return wide.where(far).withColumn("exact", F.lit(False)).unionByName(counted.withColumn("exact", F.lit(True)))


def boilerplate_lines(docs: DataFrame, least_sites: int = 10, band: float = BAND, least_words: int = 0, site_share: float = 0.0, doc_share: float = 0.0) -> DataFrame:
    """(h1, h2) of the lines on at least least_sites sites, as a written table.

    Besides, a line can be asked to have least_words words, to be on site_share of all sites, and in
    doc_share of all documents, so that common short lines and chance repeats of a large table stay.
    """
    docs = docs.select("text", "source")
    if site_share > 0 or doc_share > 0:
        n, sites = docs.agg(F.count("*"), F.count_distinct("source")).first()
        least_sites = max(least_sites, math.ceil(site_share * sites))
    wide = materialize(line_spread(docs, least_sites, band, least_words).where(F.col("sites") >= least_sites).select("h1", "h2"), "boilerplate")
    if doc_share <= 0:
        return wide
    # a document counts once for a line, equal copies each
    k1, k2 = _keys(F.col("text"))
    texts = docs.where("text is not null").groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.count("*").alias("copies"))
    held = _among(_lines(docs, least_words), wide).select("k1", "k2", "h1", "h2").distinct().join(texts, ["k1", "k2"])
    return materialize(held.groupBy("h1", "h2").agg(F.sum("copies").alias("held")).where(F.col("held") >= doc_share * n).select("h1", "h2"), "boilerplate")


def with_line_cuts(docs: DataFrame, cut: str, least_sites: int = 10, **rule) -> DataFrame:
    """docs with the column `cut`: the line numbers (from 0) that are boilerplate; null if none."""
    bad = boilerplate_lines(docs, least_sites, **rule)
    k1, k2 = unused(docs, "k1", "k2")
    hits = _among(_lines(docs), bad).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set("pos").alias(cut))
    a, b = _keys(F.col("text"))
    return docs.withColumns({k1: a, k2: b}).join(hits, [k1, k2], "left").drop(k1, k2)


def _left(cut: str) -> Column:
    """The text without the lines of cut."""
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(cut), i)), "\n")


def drop_boilerplate(docs: DataFrame, least_sites: int = 10, **rule) -> DataFrame:
    """docs, with the boilerplate lines gone from every text; a text may become empty.

    rule: least_words, site_share and doc_share of boilerplate_lines.
    n_chars, if docs has it, follows the text. All rows and columns stay.
    """
    (cut,) = unused(docs, "cut")
    out = with_line_cuts(docs, cut, least_sites, **rule).withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(_left(cut)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, least_sites: int = 10) -> DataFrame:
    """For each row of docs: doc_id, n_lines (non-blank), n_removed, and the digest of the text that is left."""
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    cut = F.col("cut")
    count = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{WS[1:]}")))
    return with_line_cuts(small, "cut", least_sites).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"),
        F.when(cut.isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.when(cut.isNull(), F.col("text")).otherwise(_left("cut")), F.lit("")), 256).alias("text_sha256"),
    )
