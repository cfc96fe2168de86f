import corpus_pipeline
from corvane.llm import decontaminate


def test_stages_over_small_tables(spark, tmp_path):
    passage = "quick brown foxes jump over many lazy dogs while seven wise owls watch them from tall oaks"
    base = "some words that make up a longer text about nothing in particular but long enough for shingles " * 3
    docs = [(i, f"{base} {' '.join(f'u{i}v{j}' for j in range(60))}", "en", "s0", 9) for i in range(12)]
    docs += [(20, docs[1][1], "en", "s0", 9), (21, f"{docs[2][1][-300:]} {passage} end", "en", "s0", 9), (22, "12 34", "en", "s0", 5), (23, None, "en", "s0", None), (24, " ".join(f"w{j}" for j in range(50)) + " password=hunter22x", "en", "s0", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert kept[0] == {*range(12), 20, 21, 24}
    assert kept[1] == kept[0] - {20} and kept[2] == kept[1] - {21} and kept[3] == kept[2]
    assert "hunter22x" not in " ".join(r["text"] for r in now.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == kept[3]
    assert decontaminate.contaminated(now, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_stages_act_on_rows_with_null_and_repeated_ids(spark, tmp_path):
    passage = "quick brown foxes jump over many lazy dogs while seven wise owls watch them from tall oaks"
    text = lambda i: " ".join(f"u{i}v{j}" for j in range(60))
    docs = [(i, text(i), "en", "s0", 9) for i in range(12)]
    # no id: no language, a passage, a copy of row 3, twice the same; one id: twice the same, and two texts of which one has no language
    docs += [(None, "12 34", "en", "s0", 5), (None, f"{text(20)} {passage}", "en", "s0", 9), (None, text(3), "en", "s0", 9)]
    docs += [(None, text(21), "en", "s0", 9)] * 2 + [(30, text(30), "en", "s0", 9)] * 2 + [(31, text(31), "en", "s0", 9), (31, "56 78", "en", "s0", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=lambda x: x[1])
    assert got == sorted([*((i, text(i)) for i in range(12)), (None, text(21)), (30, text(30)), (31, text(31))], key=lambda x: x[1])


def test_an_empty_table_and_further_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_name string, start int"
    text = lambda i: " ".join(f"u{i}v{j}" for j in range(60))
    spark.createDataFrame([(1, "some words of a benchmark item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(i, text(i), "en", "s0", 9, "own", i) for i in range(6)]):
        df = spark.createDataFrame(rows, schema)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.dtypes == df.dtypes and now.count() == len(rows)
        assert {r["row_name"] for r in now.collect()} <= {"own"}
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r[0] for r in rows}
