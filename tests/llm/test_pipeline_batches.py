"""Each stage sends Python workers small batches, also when it is called by itself."""

import corpus_pipeline

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_hand_over_small_batches(spark, sf_dir, none):
    before = spark.conf.get(RECORDS)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(RECORDS, "10000")
            stage(spark, none, sf_dir)
            assert int(spark.conf.get(RECORDS)) <= 2000
    finally:
        spark.conf.set(RECORDS, before)
