"""The pipeline's stages on odd rows, and planted copies."""

import random

import corpus_pipeline as pipeline
import pytest
from llm_rows import ODD, words
from polyquarry.llm.simhash import majority_bits
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_empty(spark, no_docs, name, stage):
    assert stage(spark, no_docs, "").count() == 0


def test_languages(spark, odd):
    out = pipeline.keep_known_languages(spark, odd.withColumns({"_score": F.lit(1), "lang_pred": F.lit("x")}), "")
    assert out.columns == [*COLUMNS, "_score", "lang_pred"]
    kept = {r.text for r in out.collect()}
    assert not kept & {None, "", "   \n\t "} and words(1, 60) in kept


def test_unlearned_languages(spark, odd):
    """Texts of random letters, in no language that labels name, go; with few or many languages clean texts stay."""
    r = random.Random(31)
    for languages in (1, 3, 6):
        stems = [words(300 + n, 40).split() for n in range(languages)]
        clean = [(i, " ".join(r.choices(stems[i % languages], k=60)), f"l{i % languages}", "a", 1) for i in range(60 * languages)]
        strange = [(10_000 + i, words(7000 + i, 60), None, "a", 1) for i in range(20)]
        kept = pipeline.keep_known_languages(spark, spark.createDataFrame(clean + strange, odd.schema), "")
        assert sorted(x.doc_id for x in kept.collect()) == [x[0] for x in clean]


def test_near_duplicates(spark, odd):
    r = random.Random(8)
    base = words(77, 200).split()
    rows = [(100 + i, " ".join(base[:k] + [r.choice("xyz") * 3] + base[k + 1 :]), "en", "a", None) for i, k in enumerate((20, 90, 150, 60))]
    docs = odd.unionByName(spark.createDataFrame(rows + [(90, words(78, 200), "en", "a", 1)], odd.schema))
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == COLUMNS
    ids = [x.doc_id for x in out.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 5, 6, 7, 8, 9, 90, 100] and ids.count(None) == 1


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    """Least ids of the components of documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, root = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("tile", [256, 8])
def test_near_duplicates_are_those_of_the_shingles(spark, odd, monkeypatch, tile):
    """Pairs around 0.8, short ones too, and one large group, against brute force."""
    r, texts = random.Random(18), []
    for n in range(240):
        base = words(1000 + n, r.choice([8, 12, 30, 120, 300])).split()
        changed, cut = list(base), max(1, round(len(base) * r.uniform(0.05, 0.3)))
        if n % 2:  # a piece at the end is another
            changed[-cut:] = words(5000 + n, cut).split()
            changed = changed[: len(base) - r.randrange(cut)]
        else:  # words here and there
            for i in r.sample(range(len(base)), max(1, cut // 5)):
                changed[i] = "x" * 9
        texts += [" ".join(base), " ".join(changed)]
    core = words(900, 100).split()
    texts += [" ".join([*core[:k], f"new{k}", *core[k + 1 :]]) for k in range(60)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    near = [5 * len(a & b) / len(a | b) for a, b in ((shingles(texts[i]), shingles(texts[i + 1])) for i in range(0, 480, 2))]
    assert sum(3.5 <= x < 4 for x in near) > 15 and sum(4 <= x < 4.25 for x in near) > 15
    whole = pipeline.minhash.least_of_groups
    monkeypatch.setattr(pipeline.minhash, "least_of_groups", lambda *a, **k: whole(*a, tile=tile, **k))
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, odd.schema), "")
    assert sorted(x.doc_id for x in out.collect()) == survivors(rows)


def test_near_duplicates_come_by_fingerprints(spark, odd, monkeypatch):
    """Without any MinHash band, copies whose SimHash fingerprints are near still meet."""
    minhash = pipeline.minhash
    fingerprint = lambda t: int(majority_bits(minhash.shingle_set(t, 5).reshape(-1, 1))[0])
    texts = []
    for n in range(12):
        base = words(4000 + n, 1500).split()
        texts += [" ".join(base), " ".join([*base[:700], f"other{n}", *base[701:]])]
    apart = [(fingerprint(texts[i]) ^ fingerprint(texts[i + 1])).bit_count() for i in range(0, 24, 2)]
    assert any(apart) and max(apart) <= 4
    monkeypatch.setattr(minhash, "band_keys", lambda hashes: __import__("numpy").empty(0, dtype="uint64"))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, odd.schema), "")
    assert sorted(x.doc_id for x in out.collect()) == survivors(rows) == list(range(0, 24, 2))


def test_estimates_of_rounds_stay_small(spark, monkeypatch):
    """A chain named at random takes many joins of checkpoints; no estimate is the product of all, whose digits fill the driver."""
    from polyquarry.llm import components

    seen, real = [], components.cut

    def kept(df):
        out = real(df)
        seen.append(out._jdf.queryExecution().logical().computeStats().simpleString())
        return out

    monkeypatch.setattr(components, "cut", kept)
    links = spark.range(299).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    least = spark.range(300).agg(F.min(F.xxhash64("id"))).first()[0]
    assert [tuple(r) for r in components.components(links).groupBy("root").count().collect()] == [(least, 300)]
    assert len(seen) > 12 and not [x for x in seen if "E+" in x]  # 8.0 EiB at most


def test_mix(spark, odd):
    out = pipeline.mix_sources(spark, odd, "")
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in out.collect()]
    assert set(plain(rows)) <= set(plain(ODD))
    assert all(rows.count(x) <= 2 * ODD.count(x) for x in set(rows))


def test_run(spark, folder):
    out = pipeline.run(spark, folder).toPandas()
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 4096


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_users_columns_keep_their_values(spark, odd):
    """Columns called like those that the stages need for themselves."""
    names = ["row", "id", "key", "content", "copies", "copy", "words", "lang_pred", "score", "_key", "_id", "_n", "size", "rank", "salt", "at", "mean", "base", "more", "total", "sid", "_metadata_"]
    docs = odd.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names)


def test_rows_of_files_are_numbered_alike(spark, odd, tmp_path):
    """Repeated rows in files have ids of their own, the same whatever else is read."""
    odd.union(odd).repartition(3).write.parquet(f"{tmp_path}/d")
    keyed = pipeline._numbered(spark.read.parquet(f"{tmp_path}/d"))
    one, two = keyed.select("id").collect(), keyed.select("id", "row").where("text IS NOT NULL").select("id").collect()
    assert len(set(one)) == len(one) == 2 * len(ODD) and set(two) < set(one)


def test_workers_without_the_package(folder, tmp_path):
    """Workers that start in another folder, without a path to the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(pipeline.__file__).resolve().parent)
    code = f"""
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from polyquarry.session import local_session
spark = local_session(2, "2g")
spark.sparkContext.environment.pop("PYTHONPATH", None)
q = entry.queries()
for name in q:
    if name == "pipeline" or name.startswith("op") and name.split("_")[0][2:] in ("2", "5", "6", "7", "8", "9"):
        print(name, q[name](spark, {folder!r}).count())
def found(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("polyquarry") is not None))
assert spark.range(1).mapInPandas(found, "id long").first()[0] == 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]
