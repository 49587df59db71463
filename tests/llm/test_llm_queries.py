"""The registered queries: their checks, the pipeline, and the entry without them."""

import oracle
import pytest

import __spark_entry__
import corpus_pipeline
from buildlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = oracle.rows_of_spark(queries.QUERIES[name](spark, sf_dir))
    assert oracle.difference(got, oracle.rows_of_duckdb(duck, queries.ORACLES[name])) is None


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(known) and "pipeline" in known


def test_stages_keep_the_columns_and_only_drop_what_they_judge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert docs.count() <= before
        if name == "line_dedup":
            assert docs.count() == before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.filter("taken <= 0 or taken > 2 * size").isEmpty() and not last.isEmpty()


#: Columns named like those that operators use themselves.
CLASHING = ["id", "key", "key2", "row", "kept", "_kept", "_key", "_id", "_row", "_doc", "_lines", "_full", "_text",
            "no", "line", "lines", "words", "n", "fp", "first", "copies", "node", "root", "component_id", "size",
            "sources", "target", "taken", "items", "spans", "n_words", "declared", "host", "accepted", "language",
            "kept_text", "band", "early", "open", "code", "mask", "digest", "part", "score", "layout", "turns"]


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])


def odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\r\n", "en", "a", 5),
            (6, "the same words again and again in one place", "en", "a", 1),
            (6, "the same words again and again in one place", "en", "a", 1),
            (None, "the same words again and again in one place", "en", None, 1),
            (7, "x" * 50_000, "en", "a", 9), (8, "and now the words of a very different text in the end", "en", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_ignore_other_columns_of_any_name(spark, sf_dir, stage):
    docs = odd_documents(spark)
    run = dict(corpus_pipeline.STAGES)[stage]
    plain, extra = run(spark, docs, sf_dir), run(spark, clashing(docs), sf_dir)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert extra.columns == [*docs.columns, *CLASHING]
        for r in extra.collect():
            assert all(r[c] == (f"{c}-{r['doc_id']}" if r["doc_id"] is not None else None) for c in CLASHING)
    assert sorted(map(repr, extra.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, sf_dir, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, odd_documents(spark).limit(0), sf_dir).collect() == []
