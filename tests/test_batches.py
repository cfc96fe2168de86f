from corvane.functions import parse


def test_batches_of_notes_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(parse.SPARKS_BYTES))
        files = spark.createDataFrame([("a.md", "# A\n\ntext\n")], "path string, content string")
        assert parse.notes(files).first()["title"] == "A"
        assert int(spark.conf.get(key)) == parse.BATCH_BYTES
        spark.conf.set(key, "1000000")  # the session's own bound holds
        parse.notes(files)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before)
