"""What an executor holds of an alignment at once: short batches for Python, and one block of documents in writer and reader."""

import glob

import pyarrow.parquet as pq

from creditgraph.llm import alignment, common


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    given, staged = {}, common.Scratch.staged

    def seen(self, df, name, **options):
        given[name] = options
        return staged(self, df, name, **options)

    monkeypatch.setattr(common.Scratch, "staged", seen)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"words of a document, number {i}") for i in range(12)], "doc_id long, text string")
    assert alignment.align(docs, *alignment.public_tokenizers()).count() == 12
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.BATCH)
    path = common.new_path(spark, "rows")
    common.staged(spark.range(12).coalesce(1), "rows", path, **given["blocks"])
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{path}/*.parquet")) == 12
