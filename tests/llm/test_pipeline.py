"""The pipeline's stages over the smallest tables, held against what each must leave."""

import os

import pytest

import corpus_pipeline as cp
from ledgerloom.llm import ngram_join, quality
from ledgerloom.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in table(spark, SF, "labels").collect()}
    judged = {r["doc_id"] for r in quality.judge(docs, least_words=cp.LEAST_WORDS).where("kept").collect()}
    seen, rows = docs, {}
    for name, stage in cp.STAGES:
        before = seen
        seen = cp.materialize(stage(spark, seen, SF), name)
        rows[name] = {r["doc_id"] for r in seen.select("doc_id").collect()}
        if name == cp.STAGES[-1][0]:
            assert seen.where("not exact").count() == 0 and seen.count() == before.count()
        else:
            assert seen.columns == docs.columns
    assert rows["quality_rules"] == judged
    assert rows["line_dedup"] == judged
    lines = cp.materialize(cp.line_dedup_stage(spark, cp.quality_rules(spark, docs, SF), SF), "lines")
    near = {r["doc_id"] for r in ngram_join.near_duplicates(lines, 5, 80).where("component_id = doc_id").collect()}
    assert rows["ngram_jaccard_join"] == near
    clean = {i for i in near if labels.get(i) == (1, 0)}
    assert len(clean - rows["mixing"]) <= 0.02 * len(clean)
    assert not {i for i, x in labels.items() if x == (1, 0)} - judged  # the rules reject no clean document
    assert not {i for i in rows["mixing"] if labels.get(i, (1, 0))[1] == 1}


def test_run_equals_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"] and got.count() > 0


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, likely string, cut string, verdict string, kept string, gone long"


def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, columns with the names of internal ones."""
    long = " ".join(f"word{i % 977} number{i} stays{i}." for i in range(5000))
    texts = [long, long, "", None, "one", "Short text of a few words.\n\nAnd more.", "A | B | C", "x " * 200]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "a", "b", "c", "d", 5) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, long, None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_edges(spark, name):
    stage = dict(cp.STAGES)[name]
    docs = spark.createDataFrame(edge_rows(), STAGE_SCHEMA)
    out = cp.materialize(stage(spark, docs, SF), name)
    rows = out.collect()
    if name != cp.STAGES[-1][0]:
        assert out.columns == docs.columns
        assert {(r["likely"], r["cut"], r["verdict"], r["kept"], r["gone"]) for r in rows} <= {("a", "b", "c", "d", 5), (None,) * 5}
    texts = {"quality_rules": {0, 1, 4, 5}, "line_dedup": {*range(8)}, "ngram_jaccard_join": {0, 2, 3, 4, 5, 6, 7}, "bpe": {*range(8)}}
    if name in texts:
        assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == texts[name]
        assert sum(r["doc_id"] == 5 for r in rows) == 2 and any(r["doc_id"] is None for r in rows)
    assert cp.materialize(stage(spark, docs.where("false"), SF), name).count() == 0
