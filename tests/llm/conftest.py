import pytest
from edge import REPEATS, ROWS, table


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, ROWS, False).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    return table(spark, ROWS, True).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [], False)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """The rows above as the tables of a folder, for the queries."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{at}/documents.parquet")
    docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") == 6).cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/a b").alias("url"), F.col("text").alias("html")).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="session")
def repeats(spark, tmp_path_factory):
    """Tables of repeated rows, over several files."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("repeats"))
    docs = table(spark, REPEATS, False)
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.example/a b").alias("url"), F.col("text").alias("html")).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="session")
def bare(spark, nothing, tmp_path_factory):
    """Empty tables."""
    at = str(tmp_path_factory.mktemp("bare"))
    nothing.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at
