"""The corpus pipeline, stage by stage, against the single operators."""

import corpus_pipeline
from tablelens.llm import decontaminate, mixing, quality, secrets, simhash
from tablelens.llm.common import read_table, stored

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    last = len(corpus_pipeline.STAGES) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources"]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, docs, SF), "stage")
        if place == 0:
            scored = quality.quality_table(docs, read_table(spark, SF, "labels"))
            assert ids(after) == ids(scored.filter("predicted = 1"))
        elif place == 1:
            found = simhash.duplicates_table(docs).collect()
            assert ids(after) == sorted({r["component_id"] for r in found})
        elif place == 2:
            assert ids(after) == ids(decontaminate.contamination_table(docs, read_table(spark, SF, "benchmark")).filter("NOT contaminated"))
        elif place == 3:
            assert ids(after) == ids(docs)
            spans = {r["doc_id"]: r["spans"] for r in secrets.secrets_table(docs).collect()}
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in after.collect():
                assert (r["text"] == before[r["doc_id"]]) == (not spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        else:
            assert sorted(map(tuple, after.collect())) == sorted(map(tuple, mixing.mix_table(docs).collect()))
        if place < last:
            assert after.columns == columns
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "token = abcdefghij " * 3, "en", "s", 57)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).selectExpr("*", "'mine' AS score", "'mine' AS row", "'mine' AS place")
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), "stage")
        assert place == 4 or "score" in docs.columns
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
