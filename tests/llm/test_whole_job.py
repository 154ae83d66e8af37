"""What the operators must not leave out: each case fails on code that does less."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import line_dedup, mixing, pii, quality
from ledgerloom.llm.common import table

from test_operators import frame

SF = "/root/testdata/sf0.001"


def test_mixing_draws_only_lowered_domains(spark):
    """Posteriors that are unsure: every row of a domain of factor 1 stays, once; none of factor 0 does."""
    r = random.Random(9)
    rows = []
    for i in range(800):
        main = i % 4
        p = [r.uniform(0.0, 0.25) for _ in range(4)]
        p[main] += 0.4
        rows.append((i, r.randint(50, 200), [x / sum(p) for x in p]))
    docs = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    factors = {"good": 1.0, "good_toxic": 0.0, "low": 0.5, "low_toxic": 0.0}
    got, totals = mixing.take_by_domain(docs, factors)
    best = {i: mixing.DOMAINS[max(range(4), key=p.__getitem__)] for i, _, p in rows}
    kept = sorted(x["doc_id"] for x in got.collect())
    assert [i for i in kept if best[i] == "good"] == [i for i in best if best[i] == "good"]
    assert {best[i] for i in kept} <= {"good", "low"} and len(kept) == len(set(kept))
    assert [t["domain"] for t in totals] == list(mixing.DOMAINS)
    low = totals[0]
    assert low["target"] == pytest.approx(0.5 * low["present"]) and low["reached"] >= low["target"] - 1e-6
    assert mixing.take_by_domain(docs.where("false"), factors)[0].count() == 0


def test_drawn_share_meets_its_target(spark):
    rows = [(i, 10, [1.0, 0.0, 0.0, 0.0] if i % 2 else [0.0, 0.0, 1.0, 0.0]) for i in range(4000)]
    got, totals = mixing.take_by_domain(spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>"), {"low": 0.3})
    assert totals[0]["reached"] == pytest.approx(0.3 * totals[0]["present"])
    n = {x["odd"]: x["count"] for x in got.groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()}
    assert n[0] == 2000 and 520 <= n[1] <= 680


def test_draws_go_by_fitted_rates(spark, monkeypatch):
    """Lowered rows are drawn by projected-gradient rates, each by its own posterior: the surer ones are rarer."""
    rows = [(i, 10, [0.9, 0.0, 0.1, 0.0] if i % 2 else [0.55, 0.0, 0.45, 0.0]) for i in range(6000)]
    fits, fit = [], mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda *a, **b: fits.append(fit(*a, **b)) or fits[-1])
    got, totals = mixing.take_by_domain(spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>"), {"low": 0.5})
    n = {x["odd"]: x["count"] for x in got.groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()}
    assert len(fits) == 1 and fits[0].met and fits[0].steps
    assert totals[0]["reached"] == pytest.approx(0.5 * totals[0]["present"]) and n[1] < 0.8 * n[0]


@pytest.mark.parametrize("n", [200, 4000])
def test_common_short_lines_stay_at_every_size(spark, n):
    """A short line everywhere and a chance line on 12 of 20 sources stay; a footer in every tenth text goes."""
    texts = [f"own words of text {i}\nOf." + ("\nRead more from this fine site." if i % 10 < 2 else "") for i in range(n)]
    if n > 200:
        texts = [t + ("\nA chance line of prose." if i < 12 else "") for i, t in enumerate(texts)]
    df = frame(spark, texts, [f"s{i}" for i in range(20)]).withColumn("source", F.concat(F.lit("s"), ((F.col("doc_id") + F.floor(F.col("doc_id") / 10)) % 20).cast("string")))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, 10, least_words=4, site_share=0.5, doc_share=0.005).collect()}
    assert got == {i: t.replace("\nRead more from this fine site.", "") for i, t in enumerate(texts)}


def test_quality_keeps_a_long_line_that_mentions_a_policy(spark):
    long = " ".join(f"Word{i}" for i in range(80))
    one = long + " The privacy policy of the town was read aloud. " + long.replace("Word", "Other")
    spaced = long + "\n\nAll rights reserved.\n \n" + long.replace("Word", "Third")
    got = {r["doc_id"]: r["text"] for r in quality.clean(frame(spark, [one, spaced])).collect()}
    assert got == {0: one, 1: spaced.replace("All rights reserved.\n", "")}


def test_pii_finds_a_card_beside_other_digits(spark):
    card = "4111 1111 1111 1111"
    texts = [card, f"{card} 123", f"{card} 12/27", f"order 7 {card}", "7 4111-1111-1111-1111", "12 3782 822463 10005", "1234 5678 9012 3456 78"]
    got = {r["doc_id"]: r for r in pii.pseudonymize(frame(spark, texts), "k").collect()}
    new = got[0]["text"]
    assert new != card
    assert [got[i]["text"] for i in range(1, 5)] == [f"{new} 123", f"{new} 12/27", f"order 7 {new}", "7 " + new.replace(" ", "-")]
    assert got[5]["text"].startswith("12 ") and "3782 822463 10005" not in got[5]["text"]
    assert got[6]["text"] == texts[6] and [got[i]["n_replaced"] for i in range(7)] == [1] * 6 + [0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_mixing_loses_no_clean_document(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    judged = cp.materialize(cp.quality_rules(spark, docs, SF), "judged")
    got = [r["doc_id"] for r in cp.mixing_stage(spark, judged, SF).select("doc_id").collect()]
    clean = [r["doc_id"] for r in judged.select("doc_id").collect() if labels.get(r["doc_id"]) == (1, 0)]
    assert clean and set(clean) <= set(got) and len(got) == len(set(got))
