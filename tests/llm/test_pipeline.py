import corpus_pipeline as pipeline
from dealflow.llm.mixing import size_of
from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401
from test_line_dedup import expected
from test_near_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    named = pipeline.language_stage(spark, docs, SF_SMALL).cache()
    assert named.columns == COLUMNS
    clean = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 20}
    assert len(clean - {r.doc_id for r in named.collect()}) <= 0.01 * len(clean)

    some = named.filter("n_chars < 700").cache()  # all pairs of lines are compared below
    lined = {r.doc_id: r for r in pipeline.line_stage(spark, some, SF_SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in some.orderBy("doc_id").collect()]
    for (doc, text), want in zip(rows, expected(rows, short_copies=True)):
        assert lined[doc].text == want and lined[doc].n_chars == len(want) if doc in lined else text.strip() and not want.strip()

    nears = {r.doc_id for r in pipeline.near_stage(spark, named, SF_SMALL).collect()}
    rows = [(r.doc_id, r.text) for r in named.orderBy("doc_id").collect()]
    assert nears == {doc for (doc, _), (_, component) in zip(rows, brute(rows, 5)) if doc == component}

    mixed = pipeline.mix_stage(spark, named, SF_SMALL)
    total = lambda df: df.select(size_of(df.text).alias("n")).groupBy().sum("n").first()[0]
    assert mixed.columns == COLUMNS and 0.9 * total(named) <= total(mixed) <= total(named)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3

    coded = pipeline.bpe_stage(spark, named, SF_SMALL)
    assert coded.filter("round_trip AND n_tokens > 0").count() == named.count()


def test_run_and_odd_rows(spark, odd_docs, no_docs):
    out = pipeline.run(spark, SF_SMALL)
    assert out.count() > 50 and out.filter("NOT round_trip").count() == 0
    for rows in (odd_docs.select(*COLUMNS), no_docs.select(*COLUMNS)):
        for _, stage in pipeline.STAGES[:-1]:
            result = stage(spark, rows, "")
            assert result.columns == COLUMNS and (rows.isEmpty() is False or result.isEmpty())
        assert pipeline.bpe_stage(spark, rows, "").count() == rows.count()


def test_workers_get_bounded_batches(spark):
    """A stage's workers get a few MB of text at a time, however long the texts are."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'en' AS lang", "'s' AS source", "5000L AS n_chars")
    pipeline.bpe_stage(spark, docs, "")
    got = docs.mapInArrow(run, "n bigint, bytes bigint").collect()
    assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) <= pipeline.BATCH_BYTES + 100_000


def test_packed_tables_have_few_files(spark, tmp_path, monkeypatch):
    """Small partitions are written together; what is made of much has many files."""
    from dealflow.llm import common, links

    def files(df):
        return len(df.inputFiles())

    few = common.FILES_A_CORE * spark.sparkContext.defaultParallelism
    spark.range(0, 50_000, 1, 1).selectExpr("id", "uuid() AS text").write.parquet(str(tmp_path / "a b%20"))
    rows = spark.read.parquet(str(tmp_path / "a b%20")).repartition(150)
    out = common.written(common.packed(rows), "test")
    assert files(out) <= few and out.count() == 50_000 and out.select("id").distinct().count() == 50_000
    monkeypatch.setattr(common, "FILE_BYTES", 20_000)
    assert files(common.written(common.packed(rows), "test")) > min(60, 2 * few)
    monkeypatch.undo()

    pairs = spark.range(0, 3000).selectExpr("id AS a", "id + 3000 AS b").repartition(120)
    stars = links.components(pairs)
    assert files(stars) <= few and {(r.node, r.root) for r in stars.collect()} == {(i + 3000, i) for i in range(3000)}
