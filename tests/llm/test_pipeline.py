import corpus_pipeline
import pytest
from dayloom.llm import queries
from tests.llm.helpers import awkward, on_disk

SMALL = "/root/testdata/sf0.001"


def test_stages_take_awkward_rows_and_none(spark, tmp_path):
    table = awkward(spark)
    for number, docs in enumerate((table, table.filter("false"))):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = on_disk(docs, tmp_path / f"{number}-{k}")
            out = stage(spark, docs, SMALL)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns, name
            docs = out
        rows = docs.collect()
        assert (len(rows) > 0) == (number == 0)


def test_run_gives_positions_of_all_tokens(spark):
    rows = sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r["start"])
    position = 0
    for r in rows:
        assert r["start"] == position
        position += r["n_tokens"]
    assert len(rows) > 100


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_read_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    table = "pages" if name in ("op5_url_filters", "op6_warc") else "documents"
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    if name == "op13_conversations":  # a row for each conversation
        n = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
    if name not in ("op2_decontamination", "op8_source_mixing"):
        assert out.count() == n
    else:
        assert out.count() > 0
