"""The pipeline's stages on a small table, each judged on its own input."""

from __future__ import annotations

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{number}.parquet")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before
        before = docs.count()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == before
