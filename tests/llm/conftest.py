import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import ODD  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """``documents`` with odd rows, as a table folder."""
    d = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="session")
def empty_folder(spark, no_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    no_docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d
