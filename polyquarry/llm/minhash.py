"""Near-duplicate groups by exact Jaccard similarity of shingle sets, candidates by SimHash fingerprints and MinHash bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import cut
from polyquarry.llm.components import components
from polyquarry.llm.simhash import SALTS, _forest, majority_bits, near_links, shingle_hashes

#: A pair of similarity J shares no band with chance (1 - J^ROWS)^BANDS: 7e-6 at J = 0.8, less above.
BANDS, ROWS = 30, 5
#: Most sets, and about the most shingles, on each side of one comparison.
TILE, TILE_SHINGLES = 256, 1 << 20


def shingle_set(text: str | None, width: int):
    """Sorted distinct hashes of the text's shingles."""
    import numpy as np

    h = np.sort(shingle_hashes(text, width)[:, 0])  # faster than np.unique, which hashes
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def band_keys(hashes, bands: int = BANDS, rows: int = ROWS):
    """A hash of each band's ``rows`` minima of the set; of an empty set, none."""
    import numpy as np

    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    r = np.random.default_rng(20)
    flips, factors = (r.integers(0, 1 << 64, (bands * rows, 1), dtype=np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ flips) * factors).min(axis=1))
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in least.reshape(bands, rows).T:
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def similar_pairs(sets: list, left, right, least: tuple[int, int]):
    """Index pairs (one of ``left``, one of ``right``) of sets whose Jaccard similarity is ``least`` (a fraction) or more."""
    import numpy as np

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    held = np.concatenate([sets[i] for i in right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(right)), sizes[right])[order]
    found_a, found_b = [], []
    for a in left:
        first, last = np.searchsorted(held, sets[a], "left"), np.searchsorted(held, sets[a], "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        b = right[(common > 0) & (common * least[1] >= (sizes[a] + sizes[right] - common) * least[0])]
        b = b[b != a]
        found_a.append(np.full(len(b), a))
        found_b.append(b)
    return np.concatenate(found_a), np.concatenate(found_b)


def least_of_groups(docs: DataFrame, key: str, text: str = "text", shingle: int = 5, least: tuple[int, int] = (4, 5), radius: int = 4, tile: int = TILE) -> DataFrame:
    """The least ``key`` of each group of documents; groups are the components of links.

    Documents link if the Jaccard similarity of their distinct shingles is ``least`` (a fraction) or more; texts without words
    link to each other. Candidates are sets whose SimHash fingerprints differ in at most ``radius`` bits, found by the bit-sliced
    comparison, and sets that share a MinHash band, each with the band's least one: fingerprints alone would miss many pairs near
    ``least``. Both give loose components; within these every pair of sets is compared by its shingles. Components of over ``tile`` sets are split, and every two
    tiles meet in a task of their own; small ones share tasks. Equal sets, told apart by 128 bits, are compared once. ``key`` is
    another for each row; the rows may come again with the same keys when ``docs`` is read twice. Empty tables give no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, sizes, bands, prints = [], [], [], []
            for value in batch.column(1):
                hashes = shingle_set(value.as_py(), shingle)
                ids.append(xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes).view(np.int64))
                prints.append(majority_bits(hashes.reshape(-1, 1))[0])
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *bands])))
            made = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[key, "_id", "_n", "_fp", "_bands"])

    signed = docs.select(key, text).mapInArrow(sign, f"`{key}` {kind}, _id binary, _n long, _fp long, _bands array<long>")
    sets = cut(signed.groupBy("_id").agg(F.min(key).alias("_least"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"), F.first("_bands").alias("_bands")))

    spread = sets.select("_id", F.explode("_bands").alias("_band"))
    shared = spread.groupBy("_band").agg(F.min("_id").alias("a"), F.count("*").alias("_many")).where("_many > 1").select("_band", "a")
    banded = spread.join(shared, "_band").select("a", F.col("_id").alias("b"))
    # sets with one fingerprint link to the least of them, which stands for them in the comparison
    prints = cut(sets.where("_n > 0").groupBy(F.col("_fp").alias("fp0")).agg(F.min("_id").alias("_id"), F.count("*").alias("_many")))
    alike = sets.where("_n > 0").join(prints.where("_many > 1").select(F.col("fp0").alias("_fp"), F.col("_id").alias("a")), "_fp").select("a", F.col("_id").alias("b"))
    printed = near_links(prints.select("fp0", "_id"), ["fp0"], radius, radius)
    # links are cut one kind at a time, so that no plan holds both
    loose = components(cut(banded.where("a <> b")).unionByName(cut(alike.where("a <> b").unionByName(printed))), "_id", "_root")
    members = cut(loose.join(sets.select("_id", "_least", "_n"), "_id"))

    # components over a tile's size: their members meet the number of tiles in SALTS places
    count, weight = members.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    buckets = max(1, -(-2 * count // tile), -(-2 * weight // TILE_SHINGLES))
    sized = members.groupBy("_root").agg(F.greatest(F.ceil(F.count("*") / F.lit(tile)), F.ceil(F.sum("_n") / F.lit(TILE_SHINGLES))).cast("int").alias("_tiles"))
    large = sized.where("_tiles > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    tiled = members.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).join(large, ["_root", "_salt"], "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    place = F.when(F.col("_tiles") > 1, F.xxhash64("_root")).otherwise(F.pmod(F.xxhash64("_root"), F.lit(buckets)))
    tiled = tiled.select(F.col("_least").alias(key), "_id", "_tiles", (F.col("_tiles") > 1).alias("_split"), place.alias("_place"), F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_tiles")).cast("int").alias("_own"))

    def shingled(batches):
        import pyarrow as pa

        for batch in batches:
            made = pa.array([shingle_set(v.as_py(), shingle).tobytes() for v in batch.column(batch.schema.get_field_index(text))], pa.binary())
            names = ["_id", "_tiles", "_split", "_place", "_own"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), made], names=[*names, "_set"])

    texts = docs.select(key, text).join(tiled, key).dropDuplicates(["_id"])  # a repeated row comes once
    found = texts.select("_id", "_tiles", "_split", "_place", "_own", text).mapInArrow(shingled, "_id binary, _tiles int, _split boolean, _place long, _own int, _set binary")
    others = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("i"), F.greatest(o, F.col("_own")).alias("j")))
    placed = found.withColumn("_pair", F.explode(others)).select("_split", "_place", F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"), "_own", "_id", "_set")

    def compare(at, part):
        import numpy as np
        import pyarrow as pa

        ids, own = part["_id"], part["_own"].to_numpy()
        held = [np.frombuffer(b, dtype=np.uint64) for b in part["_set"].to_pylist()]
        left, right = (np.nonzero(own == x.as_py())[0] for x in at[2:4])
        parents = np.arange(len(ids))
        if len(left) and len(right):
            parents = _forest(len(ids), *similar_pairs(held, left, right, least))
        order = np.nonzero(parents != np.arange(len(ids)))[0]
        return pa.table({"a": ids.take(pa.array(order)), "b": ids.take(pa.array(parents[order]))})

    links = placed.groupBy("_split", "_place", "_i", "_j").applyInArrow(compare, "a binary, b binary")
    roots = components(links, "_id", "_root")
    return sets.select("_id", "_least").join(roots, "_id", "left").groupBy(F.coalesce("_root", "_id")).agg(F.min("_least").alias(key)).select(key)
