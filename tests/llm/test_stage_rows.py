"""The pipeline's stages judge each row, not each id."""

import corpus_pipeline

LONG = " ".join(f"w{k}" for k in range(30))
OTHER = " ".join(f"v{k}" for k in range(30))
THIRD = " ".join(f"u{k}" for k in range(30))
KIND = "doc_id bigint, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_near_dedup_by_row(spark):
    # one id with two texts, a row that is repeated, null ids: one alone, one a copy of a row with an id, one repeated
    docs = [(1, LONG), (1, OTHER), (2, LONG), (3, THIRD), (3, THIRD), (None, OTHER), (None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l")]
    found = corpus_pipeline.remove_near_duplicates(spark, spark.createDataFrame(docs, KIND), "")
    assert rows(found) == sorted([(1, LONG), (1, OTHER), (3, THIRD), (None, "a b c d e f"), (None, "g h i j k l")], key=str)


def test_decontamination_by_row(spark, tmp_path):
    spark.createDataFrame([(1, LONG)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, LONG), (None, OTHER), (1, LONG), (1, THIRD), (2, None)]
    found = corpus_pipeline.remove_contaminated(spark, spark.createDataFrame(docs, KIND), str(tmp_path))
    assert rows(found) == sorted([(None, OTHER), (1, THIRD), (2, None)], key=str)
