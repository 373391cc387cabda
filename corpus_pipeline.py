"""From raw documents to packed training sequences: language ID, near-duplicates, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquarry.llm import langid, minhash, mixing, packing
from polyquarry.llm.common import boxed, checkpoint_folder, cut, quoted, remove, table, word_count

#: Documents of whose n-grams the best language explains less than this part of what it explains of its labelled texts are in no learned language.
LEAST_COVERAGE = 0.4
#: Documents link if the Jaccard similarity of their distinct five-word shingles is 4/5 or more.
SHINGLE, LEAST_SIMILARITY = 5, (4, 5)


def _content(docs: DataFrame) -> Column:
    """128 bits of hash of the whole row."""
    row = [*(F.col(quoted(c)) for c in sorted(docs.columns)), *(F.col(quoted(c)).isNull() for c in sorted(docs.columns))]
    return F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit(1), *row).alias("b"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``id`` (another for each row, the same whenever it is read), ``content`` and ``text``.

    Rows of files are named by file and place; those of other tables are written to a checkpoint and numbered there.
    """
    own = [boxed(docs), _content(docs).alias("content"), F.col("text").alias("text")]
    try:
        found = docs.select(*own, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("id"))
        found.schema  # noqa: B018 (resolves the columns)
        return found
    except AnalysisException:
        kept = cut(docs.select(*own, F.monotonically_increasing_id().alias("at")))
        return kept.select("row", "content", "text", F.struct(F.lit(0).cast("long").alias("file"), "at").alias("id"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null, empty too) and those in no learned language go. Learned from all labelled documents of ``docs``.

    Rows are judged one by one, so repeated rows share their fate; an empty table stays empty, and without any labelled document all
    go. Columns may have any names; all are kept.
    """
    labelled = docs.select("doc_id", "text", "lang")
    model = langid.fit(labelled, "doc_id")
    usual = langid.usual_coverage(labelled, model, "doc_id")
    held = docs.select(boxed(docs), F.col("text").alias("text"))
    judged = langid.predict(held, model, usual=usual)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_COVERAGE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the least doc_id (documents without one come last).

    Texts without words (null, empty, blank) are one group. Of repeated rows and of several with the least doc_id one stays, the same
    at every run but for equal rows. An empty table stays empty. Columns may have any names; all are kept as they are.
    """
    keyed = _numbered(docs)
    # doc_id first, so that the least row of a group is the one of its least doc_id
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "content", "id")
    least = minhash.least_of_groups(keyed.select(order.alias("key"), "text"), "key", shingle=SHINGLE, least=LEAST_SIMILARITY)
    stay = cut(least.select("key.id"))
    return keyed.select("row", "id").join(stay, "id", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets (weights 3, 1, 2; 150 % of all words).

    Null sources are one source, the last; texts without words (null, empty) stay once. Repeated rows get their copies each;
    which of equally long documents gets one more is decided by a hash of the row. An empty table stays empty. Columns
    may have any names; all are kept as they are.
    """
    keyed = _numbered(docs)
    sized = keyed.select("id", "content", F.col("row.source").alias("source"), word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_to_targets(sized, "content", "source", "words").where("copies > 0").select("id", "copies")
    kept = keyed.select("row", "id").join(mixed, "id")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 4096: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end. Repeated rows are packed each; an empty table gives no rows. Other columns are left out.
    """
    pieces = packing.token_pieces(docs.select("doc_id", "text"), "doc_id", "text", packing.vocabulary_path())
    slim = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(slim, order=["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` over ``documents``; what a stage returns is written as Parquet and read again by the next.

    Only the last stage's input stays in the checkpoint folder, since the result still reads it.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if number:  # what the stage before wrote has been read
                remove(spark, f"{folder}/{STAGES[number - 1][0]}")
    return docs
