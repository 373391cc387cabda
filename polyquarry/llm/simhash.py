"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import boxed, cut, quoted, table
from polyquarry.llm.components import components

SEED = 42
#: Most fingerprints that meet in one comparison; larger buckets are compared tile by tile.
TILE = 2048
#: Documents of one fingerprint that meet its component in one place.
COPIES = 1 << 18
#: Places among which the members of one component are dealt.
SALTS = 32


# --- fingerprints


def shingle_hashes(text: str | None, width: int, seeds: tuple[int, ...] = (SEED,), repeats: bool = True):
    """XXH64 of each run of ``width`` words (all words, if fewer) of the A-Z-lower-cased text, a column for each seed.

    ``repeats``: whether a run counts as often as it occurs, or once.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        grams = [joined] if words else []
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        grams = [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    if not repeats:
        grams = list(dict.fromkeys(grams))
    return np.array([[xxh64_intdigest(g, s) for s in seeds] for g in grams], dtype=np.uint64).reshape(len(grams), len(seeds))


def majority_bits(hashes, first_on_tie: bool = False):
    """One 64-bit fingerprint for each column of ``hashes``: bits set in over half the rows; of no rows, zero.

    ``first_on_tie``: where exactly half the rows have the bit, the first row's decides, which keeps fingerprints
    of few shingles from sharing zeros.
    """
    import numpy as np

    n, columns = hashes.shape
    out = np.zeros(columns, dtype=np.uint64)
    for c in range(columns):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 65536):
            part = np.ascontiguousarray(hashes[at : at + 65536, c])
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = counts * 2 > n
        if first_on_tie and n:
            own = (hashes[0, c] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            bits |= (counts * 2 == n) & (own == 1)
        out[c] = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, words: int = 1, first_on_tie: bool = False, repeats: bool = True, out: str = "fp") -> DataFrame:
    """``docs`` without ``text`` and with ``words`` longs ``out``0.. : SimHash fingerprints of the whole texts.

    Null, empty and blank texts have fingerprint zero; a column of that name is replaced.
    """
    names = [f"{out}{i}" for i in range(words)]
    kept = [c for c in docs.columns if c != text and c not in names]
    seeds = tuple(SEED + i for i in range(words))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept), *(f"`{n}` long" for n in names)])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text)
            made = np.empty((batch.num_rows, words), dtype=np.uint64)
            for i, value in enumerate(batch.column(at)):
                made[i] = majority_bits(shingle_hashes(value.as_py(), shingle, seeds, repeats), first_on_tie)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[:, i].view(np.int64)) for i in range(words))], names=[*kept, *names])

    return docs.select(*kept, text).mapInArrow(run, schema)


# --- comparison


def _planes(values):
    """Bit planes: row p holds bit p of each value, 64 values to a word."""
    import numpy as np

    padded = np.zeros(-(-len(values) // 64) * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within_radius(queries, data, radius: int, block: int = 128):
    """Index pairs (into ``queries``, into ``data``) of 64-bit values that differ in at most ``radius`` bits.

    ``data`` is held as vertical bit planes. For a block of queries, planes are XORed with the queries' bits and
    added to bit-sliced counters by a carry-save ripple, so that one machine word counts for 64 values at once. Every
    eight planes the lanes over the radius are struck out; words without live lanes leave the block, and a block
    without words is abandoned.
    """
    import numpy as np

    planes, n = _planes(data), len(data)
    levels = radius.bit_length()  # counters saturate beyond
    live_tail = np.full(planes.shape[1], ~np.uint64(0))
    if n % 64:
        live_tail[-1] = np.uint64((1 << (n % 64)) - 1)
    full = ~np.uint64(0)
    found_q, found_d = [], []
    for start in range(0, len(queries), block):
        part = queries[start : start + block]
        words = planes.shape[1]
        row, col = (x.ravel() for x in np.meshgrid(np.arange(len(part)), np.arange(words), indexing="ij"))
        dead = ~live_tail[col]
        counters = [np.zeros(len(row), dtype=np.uint64) for _ in range(levels)]
        spread = [np.where((part >> np.uint64(p)) & np.uint64(1) == 1, full, np.uint64(0)) for p in range(64)]
        for p in range(64):
            carry = planes[p][col] ^ spread[p][row]
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            dead |= carry
            if p % 8 == 7:
                over, equal = np.zeros(len(row), dtype=np.uint64), np.full(len(row), full)
                for k in reversed(range(levels)):
                    if not (radius >> k) & 1:
                        over |= equal & counters[k]
                        equal &= ~counters[k]
                    else:
                        equal &= counters[k]
                dead |= over
                alive = dead != full
                if not alive.all():
                    row, col, dead = row[alive], col[alive], dead[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    break
        if len(row):
            lanes = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            found_q.append(row[at] + start)
            found_d.append(col[at] * 64 + lane)
    if not found_q:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_q), np.concatenate(found_d)


def _forest(n: int, a, b):
    """Least member of each node's component, by minimum hooking and pointer jumping."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def block_plan(count: int, radius: int, bits: int = 64, tile: int = TILE) -> tuple[list[int], int]:
    """Part widths and how many parts make a key: the cheapest way that loses no pair.

    Two fingerprints within ``radius`` share at least m - radius of m parts. Keys of t = m - radius parts are fewer
    and longer with more parts: more copies of each row, fewer comparisons. The cost adds both.
    """
    best = None
    for t in range(1, 4):
        m = radius + t
        if m > bits:
            break
        widths = [bits // m + (i < bits % m) for i in range(m)]
        keys, key_bits = math.comb(m, t), sum(sorted(widths)[:t])
        cost = keys * count * (400 + 2.0 * count / 2 ** (key_bits + 1))
        if best is None or cost < best[0]:
            best = (cost, widths, t)
    return best[1], best[2]


def near_links(prints: DataFrame, names: list[str], radius: int, total_radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what is within reach: some word within ``radius`` bits, all words together within ``total_radius``.

    ``prints``: distinct fingerprints, long columns ``names``, checkpointed; ``_id`` names each. The links are
    spanning forests of the pairs, one for each bucket's tile pair, so a group of n gives about n links a bucket, not n^2.
    Buckets are keyed by parts of a word and lose no pair; those of over ``tile`` rows are split into tiles,
    and every two tiles meet in a task of their own.
    """
    count = prints.count()
    widths, t = block_plan(count, radius)
    starts = [sum(widths[:i]) for i in range(len(widths))]
    # only as many key bits as buckets of the tile's size need
    need = max(1, math.ceil(math.log2(max(2, 4 * count / tile))))
    keys = []
    for number, name in enumerate(names):
        for chosen in combinations(range(len(widths)), t):
            key = F.lit(len(keys)).cast("long")
            for i in chosen:
                take = min(widths[i], -(-need // t))
                key = key * F.lit(1 << take) + F.shiftrightunsigned(F.col(name), starts[i]).bitwiseAND(F.lit((1 << take) - 1))
            keys.append(F.struct(F.lit(number).alias("w"), key.alias("k")))
    spread = prints.select("_id", *names, F.explode(F.array(*keys)).alias("_at")).select("_id", *names, F.col("_at.w").alias("_w"), F.col("_at.k").alias("_key"))
    sizes = spread.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > tile)
    tiled = spread.join(sizes, "_key", "left").withColumn("_tiles", F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(tile)).cast("int"))
    tiled = tiled.withColumn("_own", F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("i"), F.greatest(o, F.col("_own")).alias("j")))
    placed = tiled.select("_w", "_key", "_own", "_id", *names, F.explode(others).alias("_pair"))
    placed = placed.select("_w", "_key", F.col("_pair.i").alias("_i"), F.col("_pair.j").alias("_j"), "_own", "_id", *names)

    def compare(key, part):
        import numpy as np
        import pyarrow as pa

        word, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        ids, own = part["_id"], part["_own"].to_numpy()
        values = np.stack([part[n].to_numpy().view(np.uint64) for n in names], axis=1)
        left, right = (np.nonzero(own == x)[0] for x in (i, j))
        parents = np.arange(len(ids))
        for at in range(0, len(left), 128):
            mine = left[at : at + 128]
            q, d = within_radius(values[mine, word], values[right, word], radius)
            a, b = mine[q], right[d]
            keep = a != b
            if len(names) > 1 and len(a):
                keep &= sum(np.bitwise_count(values[a, w] ^ values[b, w]).astype(np.int64) for w in range(len(names))) <= total_radius
            a, b = a[keep], b[keep]
            if len(a):
                merged = _forest(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, parents]))
                parents = merged
        order = np.nonzero(parents != np.arange(len(ids)))[0]
        return pa.table({"a": ids.take(pa.array(order)), "b": ids.take(pa.array(parents[order]))})

    kind = prints.schema["_id"].dataType.simpleString()
    return placed.groupBy("_w", "_key", "_i", "_j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_groups(
    docs: DataFrame,
    key: str,
    text: str = "text",
    shingle: int = 4,
    words: int = 1,
    radius: int = 4,
    total_radius: int | None = None,
    first_on_tie: bool = False,
    repeats: bool = True,
    tile: int = TILE,
) -> DataFrame:
    """``docs`` without ``text``, with fingerprint words ``fp0``.. and ``component``: the least ``key`` reachable by links.

    Documents link if their fingerprints do (``near_links``), equal ones always; equal fingerprints are compared once. Null,
    empty and blank texts share fingerprint zero and link to each other. Null keys never name a component
    unless all keys in it are null. Empty tables give empty results, repeated rows stay. Columns called like the new ones are
    replaced, others may have any names.
    """
    names = [f"fp{i}" for i in range(words)]
    docs = docs.select(boxed(docs, but=(text, "component", *names)), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    printed = cut(fingerprints(docs, "text", shingle, words, first_on_tie, repeats))
    prints = printed.groupBy(*names).agg(F.min("key").alias("_least"), F.ceil(F.count("*") / F.lit(COPIES)).cast("long").alias("_places"))
    # a single word is its own id; several are named by a hash of them, whose order doesn't matter
    ident = F.col("fp0") if words == 1 else F.xxhash64(*names)
    prints = cut(prints.withColumn("_id", ident))
    links = near_links(prints, names, radius, total_radius if total_radius is not None else radius, tile)
    roots = components(links, "_id", "_root")
    rooted = cut(prints.select("_id", "_least", "_places").join(roots, "_id", "left"))
    alone = rooted.where("_root IS NULL").select("_id", "_places", F.col("_least").alias("component"))
    # a component may hold a large part of all fingerprints: its members meet its least key in SALTS places
    linked = rooted.where("_root IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    least = linked.groupBy("_root").agg(F.min("_least").alias("component")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = alone.unionByName(linked.join(least, ["_root", "_salt"]).select("_id", "_places", "component"))
    # documents with one fingerprint meet its component in places of COPIES documents each
    hot = F.broadcast(prints.where("_places > 1").select("_id", F.col("_places").alias("_of")))  # one row for COPIES documents, at most
    dealt = printed.withColumn("_id", ident).join(hot, "_id", "left").withColumn("_place", F.pmod(F.monotonically_increasing_id(), F.coalesce("_of", F.lit(1).cast("long"))))
    named = named.select("_id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_places") - 1)).alias("_place"))
    return dealt.join(named, ["_id", "_place"]).select("row.*", *names, "component")


def op5_simhash_groups(spark, sf_dir):
    """All documents: 4-word shingles, links at 4 or fewer differing bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_groups(docs, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash_groups": op5_simhash_groups}
ORACLES: dict[str, str] = {}
