"""Scratch tables and columns out of the way."""

import os

import pyspark.sql.functions as F

from tidemark.runtime import drop_stash, sheltered, stash, temporary, where_computed


def folder(df):
    return df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")


def test_tables_go_with_their_block(spark):
    with temporary(spark):
        with temporary(spark):
            inner, kept = stash(spark.range(3), "inner"), stash(spark.range(4), "kept", lasting=True)
            gone, there = folder(inner), folder(kept)
        assert not os.path.exists(gone) and kept.count() == 4
        out = stash(kept, "out", lasting=True)
    assert not os.path.exists(there) and out.count() == 4
    left = folder(out)
    drop_stash(out)
    assert not os.path.exists(left)


def test_columns_get_their_names_back(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, _row int, own_row int, Size int, _text int")
    away, back = sheltered(df, "size", but=("_text",))
    assert away.columns == ["a", "own_own_row", "own_row", "ownSize", "_text"]
    assert back(away.withColumn("_row", F.lit(9)).drop("_row")).columns == df.columns
    assert where_computed(df.withColumnRenamed("a", "_once"), F.col("_row") == 2).columns[0] == "_once"
