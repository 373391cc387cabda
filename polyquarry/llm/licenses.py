"""Licence scans by a positional index of rare words.

Main path in DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import cut, quoted, table, unlike, values
from polyquarry.llm.license_texts import TEXTS

#: Word characters: digits, Latin letters, everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: label, phrase. Fixed values of the registered query.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased; null: none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def _split(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _templates(texts, base) -> list[tuple]:
    """(label, words, key start, key length, is base): base phrases are templates that are all key phrase."""
    made = [(label, words, 0, len(words), True) for label, phrase in base for words in [_split(phrase)]]
    for label, phrase, text in texts:
        words, key = _split(text), _split(phrase)
        start = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
        if start is None or not key:
            raise ValueError(f"the text of {label} doesn't hold its key phrase")
        made.append((label, words, start, len(key), False))
    return made


def scan_licenses(docs: DataFrame, key: list[str], text: str = "text", templates=TEXTS, base=BASE, rare: int = 2) -> DataFrame:
    """``key`` columns, n_words, places (label, start, length, is_base of every verified phrase), base_labels, labels, score.

    Of a file only words of the templates are kept, with positions; a word's weight is its inverse document frequency over all
    of ``docs``. The index is a table of postings (word, template, position):

    1. Of each template's key phrase the ``rare`` highest-weighted words are its anchors. A file looks up those of its words
       that are anchors; a word's position less its posting's is where the phrase would start. Starts that all anchors of a
       template name are candidates. Every occurrence of a phrase holds its anchors, so none is lost.
    2. Candidates look for all other words of their template in place, by a join on (file, position, word). Those with the whole
       key phrase are verified.

    score: the largest share of a template's weight that stands in place around a verified phrase of it; a base phrase that
    only stands alone counts 0.5; without any, 0. Lists of labels are distinct and sorted. Null and empty texts have no
    words; repeated rows stay; empty tables stay empty. A key called like a new column keeps its name, the new column gets an
    underscore behind its own. Postings are broadcast: as many as the templates have words, whatever ``docs`` holds.
    """
    spark = docs.sparkSession
    new = {n: unlike(n, key) for n in ("n_words", "places", "base_labels", "labels", "score")}
    known = _templates(templates, base)
    vocabulary = sorted({w for t in known for w in t[1]})
    read = docs.select(F.struct(*(F.col(quoted(k)) for k in key)).alias("row"), words_of(F.col(quoted(text))).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary))
    kept = cut(read.select(F.monotonically_increasing_id().alias("id"), "row", F.size("words").cast("long").alias("n_words"), at.alias("at")))

    words_in = F.array_distinct(F.transform("at", lambda x: x["w"]))
    df = {r[0]: r[1] for r in kept.select(F.explode(words_in).alias("w")).groupBy("w").count().collect()}  # at most the vocabulary
    total = kept.count()
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary}

    anchors, parts, about = [], [], []
    for t, (label, words, first, length, is_base) in enumerate(known):
        order = sorted(range(length), key=lambda i: (-idf[words[first + i]], i))[:rare]
        anchors += [(words[first + i], t, i, len(order)) for i in order]
        whole = sum(idf[w] for w in words)
        parts += [(t, i - first, w, idf[w] / whole, int(first <= i < first + length)) for i, w in enumerate(words)]
        about.append((t, label, length, is_base))
    postings = F.broadcast(values(spark, anchors, "w string, t int, p int, need int"))
    parts = F.broadcast(values(spark, parts, "t int, p int, w string, weight double, keyed int"))
    about = F.broadcast(values(spark, about, "t int, label string, length int, is_base boolean"))

    rarest = sorted({a[0] for a in anchors})
    met = kept.where(F.exists("at", lambda x: x["w"].isin(rarest)))  # other files have no phrase
    looked = met.select("id", F.explode(F.filter("at", lambda x: x["w"].isin(rarest))).alias("x")).select("id", "x.w", "x.i").join(postings, "w")
    starts = looked.groupBy("id", "t", (F.col("i") - F.col("p")).alias("start")).agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    wanted = starts.join(parts, "t").select("id", "t", "start", (F.col("start") + F.col("p")).alias("i"), "w", "weight", "keyed")
    present = met.select("id", F.explode("at").alias("x")).select("id", "x.w", "x.i")
    standing = wanted.join(present, ["id", "i", "w"]).groupBy("id", "t", "start").agg(F.sum("keyed").alias("keyed"), F.sum("weight").alias("share"))
    verified = standing.join(about, "t").where("keyed = length")
    place = F.struct("label", "start", "length", "is_base")
    share = F.when(F.col("is_base"), 0.5).otherwise(F.least("share", F.lit(1.0)))
    by_file = verified.groupBy("id").agg(F.array_sort(F.collect_list(place)).alias("places"), F.max(share).alias("score"))

    def labels(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")

    found = kept.select("id", "row", "n_words").join(by_file, "id", "left")
    found = found.withColumn("places", F.coalesce("places", F.array().cast("array<struct<label:string,start:int,length:int,is_base:boolean>>")))
    made = {"n_words": F.col("n_words"), "places": F.col("places"), "base_labels": labels(F.filter("places", lambda x: x["is_base"])), "labels": labels(F.col("places")), "score": F.coalesce("score", F.lit(0.0))}
    return found.select("row.*", *(c.alias(new[n]) for n, c in made.items()))


def op10_license_index(spark, sf_dir):
    """All documents: places of the base phrases, labels of these and of the templates."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    starts = F.transform(F.filter("places", lambda x: x["is_base"]), lambda x: x["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), "base_labels", "labels", "score")


QUERIES = {"op10_license_index": op10_license_index}
ORACLES: dict[str, str] = {}
