"""Each operator against a brute-force version on odd rows: nulls, empty, long, repeated, ties, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_rows import ODD, words
from pyspark.sql import functions as F

from polyquarry.llm import gif, knn, langid, licenses, lm, mixing, packing, registry, sharding, simhash, urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run(spark, name, folder):
    return registry.queries()[name](spark, folder).toPandas()


def by_row(frame, *columns):
    """Results in the order of ODD, by doc_id; rows of one doc_id are alike but for placement."""
    return frame.sort_values([c for c in ("doc_id", *columns)], na_position="last").reset_index(drop=True)


@pytest.mark.parametrize("name", ["op1_rendezvous_shards", "op2_entropy_mix", "op3_url_rules", "op4_voronoi_top5", "op5_simhash_groups", "op6_best_fit_packs", "op7_gif_media", "op8_language_filters", "op9_log_frequency_scores", "op10_license_index"])
def test_empty_tables(spark, empty_folder, name):
    assert len(run(spark, name, empty_folder)) == 0


# --- 1


def xx_long(v, seed=42):
    return xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)


def shard_by_hand(key, shards):
    best = None
    for s in range(shards):
        h = xx_long(key) if key is not None else 42
        h = xxhash.xxh64_intdigest(int(s).to_bytes(4, "little", signed=True), h)
        bid = -math.log(((h >> 11) + 0.5) / 2**53)
        best = min(best or (bid, s), (bid, s))
    return best[1]


def test_shards(spark, folder):
    got = run(spark, "op1_rendezvous_shards", folder)
    assert len(got) == len(ODD)
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.shard == shard_by_hand(key, 24) and r.grown_shard == shard_by_hand(key, 25)
        assert r.grown_shard in (r.shard, 24)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    texts = {k: (t or "") for k, t, *_ in ODD}
    for r in got.dropna(subset=["doc_id"]).itertuples():
        raw = texts[int(r.doc_id)].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")


def test_shard_weights(spark):
    df = spark.range(20_000).withColumn("s", sharding.rendezvous(["id"], [1, 3, 0]))
    n = {r[0]: r[1] for r in df.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(["id"], [0, 0])


def test_shards_clashing_columns(spark):
    df = spark.range(50).withColumns({"shard": F.lit("x"), "slot": F.lit(1), "_n": F.lit(2)})
    out = sharding.shard_rows(df, ["id"], [1.0] * 3, ["id"]).toPandas()
    assert len(out) == 50 and set(out["shard"]) <= {0, 1, 2}


# --- 2


def test_targets():
    assert mixing.targets_by_weight([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, 83.33333333333333, 166.66666666666666]
    assert mixing.targets_by_weight([10, 0, 10], [1, 1, 1], 2, 2) == [20.0, 0.0, 20.0]
    assert mixing.targets_by_weight([], [], 1.5, 2) == []


def test_mix(spark, folder):
    got = run(spark, "op2_entropy_mix", folder)
    assert len(got) == len(ODD)
    sizes = Counter()
    for _, t, _, s, _ in ODD:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    targets = dict(zip(names, mixing.targets_by_weight([sizes[n] for n in names], [3, 1, 2, 3], 1.5, 2), strict=True))
    assert (got.taken <= 2 * got["size"]).all()
    for name in names:
        part = got[np.isclose(got.target, targets[name]) & (got.source_size == sizes[name])]
        assert len(part) and abs(part.taken.sum() - targets[name]) <= part["size"].max()
    again = run(spark, "op2_entropy_mix", folder)
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].fillna(-1).values.tolist() == again.sort_values(key)[key].fillna(-1).values.tolist()


def test_mix_meets_targets(spark):
    r = random.Random(5)
    rows = [(i, "abc"[min(2, int(r.expovariate(1)))], r.randint(0, 400)) for i in range(3000)]
    out = mixing.mix_to_targets(spark.createDataFrame(rows, "id long, source string, size long"), "id", "source", "size").toPandas()
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 10 and part.copies.max() <= 2


# --- 3


def verdict_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(LOWER), m[2]
    fit = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


URLS = ["http://A.Example.COM/en/71?x", "https://example.com/en/8#y", "no scheme", None, "", "x://", "http://com/en/", "http://notexample.net/de/8", "ftp://b.example.net/de/81", "http://example.net/de/7://en/", "http://org/es", "http://a.b.c.org/es/1", "http://com", "http://example.com?/en/7"]


def test_urls(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = run(spark, "op3_url_rules", str(tmp_path))
    want = sorted((i, *map(str, verdict_by_hand(u))) for i, u, _ in rows)
    assert sorted((r.page_id, r.host, r.path, str(r.rule if isinstance(r.rule, str) else None), r.verdict) for r in got.itertuples()) == want


def test_urls_without_broadcast_and_full_bloom(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "rule long, url string")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules, broadcast_rules=0).collect()
    assert sorted((r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted(tuple(map(str, verdict_by_hand(u))) for u in URLS)
    full = urlfilter.BlockedBloom({0: -1}, 1, 3)
    assert spark.range(3).where(full.may_hold(F.col("id").cast("string"))).count() == 3


def test_urls_against_a_million_rules(spark):
    """A long list: the filter still drops nearly all that isn't listed, the shuffled join finds what is."""
    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/a/").alias("path"), F.lit("block").alias("verdict"))
    bloom = urlfilter.BlockedBloom.build(rules.select(F.concat("host", F.lit("\n"), "path").alias("key")), "key", 1_000_000)
    strange = spark.range(50_000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("key"))
    assert strange.where(bloom.may_hold(F.col("key"))).count() < 1000
    pages = spark.range(0, 2_000_000, 997).select("id", F.concat(F.lit("http://X.H"), F.col("id").cast("string"), F.lit(".com/a/b")).alias("u"), F.lit("mine").alias("key"))
    got = urlfilter.judge_urls(pages, rules, url="u").collect()
    assert len(got) == len(range(0, 2_000_000, 997)) and all(r.key == "mine" for r in got)
    assert all((r.verdict, r.rule) == (("block", f"h{r.id}.com/a/") if r.id < 1_000_000 else ("allow", None)) for r in got)


def test_urls_odd_rules(spark):
    """Ties, repeated and null rules, very long URLs, no rules."""
    schema = "host string, path string, verdict string"
    pages = spark.createDataFrame([(1, "http://ab/c"), (2, "http://a/bc" + "x" * 200_000), (3, None), (3, None)], "id long, url string")
    rules = spark.createDataFrame([("ab", "/c", "block"), ("ab", "/c", "allow"), (None, "/", "block"), ("", "", "block"), ("a", "/b", "block"), ("a", "/b", "block")], schema)
    got = sorted((r.id, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect())
    assert got == [(1, "ab/c", "allow"), (2, "a/b", "block"), (3, "", "block"), (3, "", "block")]
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- 4


def test_knn(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(40)]  # copies of one vector
    rows += [(50, rows[50][1], 0), (50, rows[8][1], 0), (2400, [], 0), (2401, [], 0)]  # repeated ids and rows, empty vectors
    rows += [(2000, None, 0), (2050, [1.0, None] + [0.0] * 6, 0), (2100, [float("nan")] * 8, 0), (2150, [float("inf")] + [0.0] * 7, 0), (2200, [1.0, 2.0], 0), (2250, [0.5, -3.0], 0), (None, rows[0][1], 0), (2300, [], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = run(spark, "op4_voronoi_top5", str(tmp_path))
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for m, (i, x) in enumerate(fine) if m != n and len(x) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)


def test_knn_prunes_clusters(spark):
    """Far clusters: rows go to few groups only, and results stay exact."""
    r = random.Random(6)
    rows = [(i, [(40.0 if i % 4 == j else 0.0) + r.gauss(0, 1) for j in range(4)]) for i in range(800)]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v").withColumn("row", F.col("vec_id"))
    got = knn.top_k(data.where("vec_id % 10 = 0"), data, k=3, pivots=12, block=50).toPandas()
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for i in range(0, 800, 10):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:3]
        assert got[got.query_id == i].sort_values("rank").vec_id.tolist() == [j for _, j in best]


def test_knn_small_blocks(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(500)]
    data = knn.quantised(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v").withColumn("row", F.col("vec_id"))
    got = knn.top_k(data.where("vec_id % 10 = 0"), data, k=3, pivots=6, block=37).toPandas()
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows}
    for i in range(0, 500, 10):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:3]
        assert got[got.query_id == i].sort_values("rank").vec_id.tolist() == [j for _, j in best]


def test_scores_are_exact():
    big = np.array([[2**40, 1]], dtype=np.int64)
    assert knn.scores(big, np.array([[2**20, 3]], dtype=np.int64))[0, 0] == 2**60 + 3
    with pytest.raises(ValueError):
        knn.scores(big, big)


# --- 5


def print_by_hand(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, radius):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash(spark, folder):
    got = run(spark, "op5_simhash_groups", folder)
    prints = [print_by_hand(t) for _, t, *_ in ODD]
    roots = classes(prints, 4)
    least = {}
    for (k, *_), root in zip(ODD, roots, strict=True):
        if k is not None:
            least[root] = min(least.get(root, k), k)
    want = sorted((str(k), f"{p:016x}", str(least.get(r))) for (k, *_), p, r in zip(ODD, prints, roots, strict=True))
    text = lambda v: str(None if v != v else int(v))
    assert sorted((text(r.doc_id), r.fingerprint, text(r.component_id)) for r in got.itertuples()) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 10])
def test_bit_sliced_comparison(radius):
    r = np.random.default_rng(radius)
    data = r.integers(0, 2**64, 500, dtype=np.uint64)
    near = data[:130] ^ (np.uint64(1) << r.integers(0, 64, 130, dtype=np.uint64))
    a, b = simhash.within_radius(near, data, radius)
    want = np.nonzero(np.bitwise_count(near[:, None] ^ data[None, :]) <= radius)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*(x.tolist() for x in want), strict=True))


def test_tiles_lose_no_link(spark):
    """A chain in one bucket, cut into small tiles, stays one component."""
    r = random.Random(9)
    value, rows = r.getrandbits(64), []
    for i in range(300):
        rows.append((i, value - (1 << 64) if value >> 63 else value))
        for b in r.sample(range(40), 3):
            value ^= 1 << b
    prints = spark.createDataFrame(rows, "_id long, fp0 long").checkpoint() if spark.sparkContext.getCheckpointDir() else spark.createDataFrame(rows, "_id long, fp0 long")
    from polyquarry.llm.components import components

    links = simhash.near_links(prints, ["fp0"], 4, 4, tile=16)
    roots = {x["_id"]: x["_root"] for x in components(links, "_id", "_root").collect()}
    assert len(set(roots.values())) == 1 and len(roots) == 300


def test_simhash_hot_fingerprints(spark, folder, monkeypatch):
    """Copies dealt over places give what they give in one; columns of users keep their values."""
    one = run(spark, "op5_simhash_groups", folder)
    monkeypatch.setattr(simhash, "COPIES", 2)
    many = run(spark, "op5_simhash_groups", folder)
    key = lambda f: sorted(map(str, f[["doc_id", "fingerprint", "component_id"]].values.tolist()))
    assert key(one) == key(many)
    docs = spark.createDataFrame([(i, "same text", f"mine {i}", i) for i in range(9)], "key long, text string, _id string, _places long")
    got = simhash.near_groups(docs.withColumn("component", F.lit("old")), "key").collect()
    assert all((r.component, r["_id"], r["_places"]) == (0, f"mine {r.key}", r.key) for r in got) and len(got) == 9


def test_balance_solves_the_dual(spark):
    """Tilts against a plain bisection of each source's equation, easy targets and hard ones."""
    r = random.Random(11)
    cells, totals = [], {}
    for sid, share in enumerate((0.3, 0.999, 1.5, 1.99, 0.01)):
        sizes = {r.randint(1, 4000) if sid % 2 else 1 + int(r.expovariate(0.05)): r.randint(1, 50) for _ in range(80)}
        cells += [(sid, size, n) for size, n in sizes.items()]
        whole, docs = sum(size * n for size, n in sizes.items()), sum(sizes.values())
        totals[sid] = (share * whole, whole / docs)
    got = mixing.balance(spark.createDataFrame(cells, "sid int, size long, n long"), totals, 2.0)
    for sid, (target, mean) in totals.items():
        mine = [(size, n) for s, size, n in cells if s == sid]
        taken = lambda t: sum(n * size * min(2.0, math.exp(min(700.0, t * size / mean))) for size, n in mine)  # noqa: E731, B023
        low, high = -700.0, 700.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if taken((low + high) / 2) < target else (low, (low + high) / 2)
        assert taken(got[sid]) == pytest.approx(target, rel=1e-6) and got[sid] == pytest.approx(high, rel=1e-4, abs=1e-5)


def test_mix_clashing_columns(spark):
    rows = [(i, "ab"[i % 2], 1 + i % 5, *[f"mine {i}"] * 8) for i in range(40)] + [(3, "b", 4, *["mine 3"] * 8)]
    df = spark.createDataFrame(rows, "key long, src string, words long, mean string, base string, more string, total string, sid string, at string, size string, row string")
    out = mixing.mix_to_targets(df, "key", "src", "words").collect()
    assert len(out) == 41 and all(r[c] == f"mine {r.key}" for r in out for c in ("mean", "base", "more", "total", "sid", "at", "size", "row"))


def test_block_plan_keeps_all_pairs():
    for n in (10, 10**6, 10**9, 10**12):
        widths, t = simhash.block_plan(n, 4)
        assert sum(widths) == 64 and len(widths) - 4 == t


# --- 6


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    got = run(spark, "op6_best_fit_packs", folder)
    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for k, t, *_ in ODD:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[str(k), p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.offset == part.length.cumsum() - part.length).all() and part.length.sum() <= 4096


def test_best_fit_plan_is_best_fit_decreasing():
    import bisect

    r = random.Random(1)
    for _ in range(200):
        top = r.choice([7, 16, 64, 300])
        items = [r.randint(1, top) if r.random() < 0.5 else r.choice([1, 2, top // 3 + 1, top]) for _ in range(r.randrange(0, 300))]
        rest, bins = [], 0
        for x in sorted(items, reverse=True):
            i = bisect.bisect_left(rest, x)
            if i == len(rest):
                bins, room = bins + 1, top
            else:
                room = rest.pop(i)
            if room - x:
                bisect.insort(rest, room - x)
        counts, fill = Counter(items), Counter()
        for length, rank, each, first, _ in (runs := sorted(packing.best_fit_plan(counts, top))):
            following = [s for n, s, *_ in runs if n == length and s > rank]
            for j in range(min(following, default=counts[length]) - rank):
                fill[first + j // each] += length
        assert len(fill) == bins and sorted(top - v for v in fill.values() if v < top) == rest


def ids_by_hand(tok, texts):
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def split_ids(ids, sizes):
    return [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_are_the_tokenisers():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    ids = packing.TextIds(packing.vocabulary_path())
    texts = ["", None, "  \n", "a<|endoftext|>b <|x", "<|endoftext|>.", "é́ ﬁ İ ΑΣ x y\x1cz don't 12ab３", "a​ ' 's x's ́ ́a a.́ a., ́", "日本語 text", "\x0b\x0c a\x85b \xa0c", "Word, WORD. word.,|~ ... A1 1A #x# x_y", words(1, 300)]
    assert split_ids(*ids.encode(pa.array(texts), 1)) == ids_by_hand(tok, texts)
    none, sizes = ids.encode(pa.array([], pa.string()), 1)
    assert len(none) == len(sizes) == 0


def test_ids_of_every_letter():
    """Every letter before signs, alone and in a word; every plain one is lower-cased as the tokeniser does."""
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    ids = packing.TextIds(packing.vocabulary_path())
    letters = [c for c in map(chr, range(65, sys.maxunicode + 1)) if c.isalpha()]
    texts = ["\u0130.", "ab\u0130, \u0130b.", "\u0915\u095d, \u0915\u095d.", "\ufb1f.,", *(" ".join(f"{c}. a{c}, {c}{c}" for c in letters[i : i + 2000]) for i in range(0, len(letters), 2000))]
    signs = "".join(map(chr, range(33, 127)))
    texts += [" ".join(f"ab{a}{b} {a}{b}ab" for a in signs for b in signs)]
    assert split_ids(*ids.encode(pa.array(texts), 1)) == ids_by_hand(tok, texts)


def test_pieces_of_sliced_batches(spark, monkeypatch):
    """Pieces don't depend on how much text is tokenised at once; keys may be called like new columns."""
    rows = [(i, words(i, 3 + 1500 * (i % 5))) for i in range(30)] + [(30, None), (30, None)]
    docs = spark.createDataFrame(rows, "piece long, text string").coalesce(1)
    whole = packing.token_pieces(docs, "piece", "text", packing.vocabulary_path(), context=512).collect()
    monkeypatch.setattr(packing, "SLICE", 9000)
    parts = packing.token_pieces(docs, "piece", "text", packing.vocabulary_path(), context=512).collect()
    assert whole == parts and whole[0].asDict().keys() == {"piece", "piece_", "start", "length", "ids"}
    assert Counter(r.piece for r in whole)[30] == 2 and all(len(r.ids) == 4 * r.length for r in whole)


def test_pack_clashing_columns(spark):
    rows = [(i, 1 + i % 7, "x", -1, i, i, i) for i in range(60)] + [(5, 6, "x", -1, 5, 5, 5)]
    df = spark.createDataFrame(rows, "rank long, length long, offset string, salt long, h long, row long, g long")
    out = packing.pack(df, context=8).toPandas()
    assert len(out) == 61 and sorted(out["rank"]) == sorted(r[0] for r in rows) and (out["salt"] == -1).all() and (out["h"] == out["g"]).all()
    for _, part in out.groupby("sequence_id"):
        assert sorted(part.offset) == [0, *part.sort_values("offset").length.cumsum()[:-1]]


def test_pack_rejects_long_pieces(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "id long, length long"), context=8)


# --- 7


def test_media(spark, folder):
    got = by_row(run(spark, "op7_gif_media", folder))
    want = sorted(ODD, key=lambda r: (r[0] is None, r[0]))
    for r, (_, t, *_) in zip(got.itertuples(), want, strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = gif.encode_gif(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("root", [2, 4, 8])
def test_lzw_round_trip(root):
    r = random.Random(root)
    for n in (0, 1, 2, 300, 30_000):
        for data in (bytes(r.randrange(1 << root) for _ in range(n)), bytes(n), bytes(i * 7 // 3 % (1 << root) for i in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data, root), root, n) == data


def test_known_stream():
    """A published example: ten by ten pixels in four colours."""
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    rows = gif.lzw_decode(stream, 2, 100)
    assert rows[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and rows[90:] == bytes([2, 2, 2, 2, 2, 1, 1, 1, 1, 1])


def animation(frames, palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    """frames: (left, top, w, h, disposal, transparent, samples, interlaced)"""
    out = [b"GIF89a", (4).to_bytes(2, "little") * 2, b"\xf1\0\0", palette]
    for left, top, w, h, disposal, clear, samples, interlaced in frames:
        out.append(bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 10, 0, clear or 0, 0]))
        out.append(b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([0x40 if interlaced else 0, 2]))
        out.append(gif._blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join([*out, b"\x3b"])


def test_disposal_and_transparency():
    data = animation([(0, 0, 4, 4, 0, None, [1] * 16, False), (1, 1, 2, 2, 3, 0, [2, 0, 0, 2], False), (0, 0, 2, 2, 2, None, [3] * 4, False), (3, 3, 1, 1, 0, None, [2], False)])
    shown = [f.rgb.argmax(axis=2) * f.opaque - ~f.opaque for f in gif.decode_gif(data)]
    red, green, blue, none = 0, 1, 2, -1
    assert shown[1].tolist() == [[red] * 4, [red, green, red, red], [red, red, green, red], [red] * 4]
    assert shown[2].tolist() == [[blue, blue, red, red], [blue, blue, red, red], [red] * 4, [red] * 4]  # the second frame is gone
    assert shown[3].tolist() == [[none, none, red, red], [none, none, red, red], [red] * 4, [red, red, red, green]]  # the third is cleared
    assert [f.delay_ms for f in gif.decode_gif(data)] == [100] * 4


def test_interlace_and_frames_table(spark):
    straight, mixed = [1] * 4 + [2] * 4 + [3] * 4 + [0] * 4, [1] * 4 + [3] * 4 + [2] * 4 + [0] * 4
    one = next(gif.decode_gif(animation([(0, 0, 4, 4, 0, None, straight, False)])))
    two = next(gif.decode_gif(animation([(0, 0, 4, 4, 0, None, mixed, True)])))
    assert (one.rgb == two.rgb).all()
    df = spark.createDataFrame([(1, bytearray(animation([(0, 0, 4, 4, 0, None, straight, False)] * 2)), 5), (2, None, 6)], "id long, content binary, frame int")
    rows = gif.frames(df).orderBy("frame").collect()
    assert [(r.id, r.frame, sum(r.histogram)) for r in rows] == [(1, 0, 16), (1, 1, 16)]


def test_no_gif():
    with pytest.raises(ValueError):
        list(gif.decode_gif(b"PNG"))
    assert len(list(gif.decode_gif(gif.encode_gif(b"x" * 192 * 600)))) == 3


# --- 8


def test_language_queries(spark, folder):
    got = run(spark, "op8_language_filters", folder)
    assert len(got) == len(ODD)
    for r in got.dropna(subset=["doc_id"]).itertuples():
        text = {k: t for k, t, *_ in ODD}[int(r.doc_id)]
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r.score <= 1


def test_languages_are_told_apart(spark):
    vocab = {"xx": ["bana", "tolo", "miri"], "yy": ["schtra", "krumpf", "gletz"], "zz": ["ñuío", "ación", "llera"]}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(vocab[n]) + r.choice("aeiou") for _ in range(30)), n) for i in range(300) for n in [r.choice(list(vocab))]]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.fit(docs.where("id < 200"), "id")
    out = langid.predict(docs.where("id >= 200").withColumn("lang_pred", F.lit(1)), model).toPandas()
    assert (out.lang_pred == out.lang).all()
    assert langid.fit(docs.limit(0), "id").decide("abc") == ("und", 0.0)


def test_filter_returns_all_languages():
    grams = [np.array([1, 2, 3], dtype=np.uint64), np.array([3, 4], dtype=np.uint64)]
    f = langid.LanguageFilter.build(["a", "b"], grams, (2,), bits_per_gram=64)
    assert next(f.masks(np.array([1, 2, 3, 4], dtype=np.uint64))).tolist() == [1, 1, 3, 2]


def decide_by_hand(model_grams, text):
    """Shares of n-grams found in plain sets, without a filter; None where two languages come close."""
    codes = langid._letters(text)
    h = langid._hashes(codes, (2, 3, 4)).tolist()
    hits = sorted(((sum(x in own for x in h), name) for name, own in model_grams.items()), reverse=True)
    return hits[0][1] if hits[0][0] > 1.05 * hits[1][0] + 5 else None


def test_many_languages_decide_like_sets(spark):
    """Over 64 languages, each against exact n-gram sets."""
    r = random.Random(4)
    vocab = {f"l{k:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(r.choice(vocab[n]) for _ in range(40)), n) for i in range(1400) for n in [f"l{i % 70:02}"]]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    model = langid.fit(docs.where("id < 1050"), "id")
    out = langid.predict(docs.where("id >= 1050"), model, keep_text=True).toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.99
    counts = {name: Counter(x for i, t, n in rows if i < 1050 and n == name for x in langid._hashes(langid._letters(t), (2, 3, 4)).tolist()) for name in vocab}
    rates = {name: {x: c / sum(own.values()) for x, c in own.items() if c > 1} for name, own in counts.items()}
    top = Counter()
    for own in rates.values():
        for x, v in own.items():
            top[x] = max(top[x], v)
    sets = {name: {x for x, v in own.items() if v >= 0.5 * top[x]} for name, own in rates.items()}
    checked = [(got, want) for got, t in zip(out.lang_pred, out.text, strict=True) if (want := decide_by_hand(sets, t)) is not None]
    assert len(checked) > 300 and all(got == want for got, want in checked)


# --- 9


def lm_by_hand(rows):
    tokens = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "\n"]) for k, t, *_ in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in tokens]
    count = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    train = [ws for (_, ws), h in zip(tokens, held, strict=True) if not h]
    pairs = Counter(p for ws in train for p in zip([None, *ws], ws))  # noqa: B905
    triples = Counter(p for ws in train for p in zip([None, None, *ws], [None, *ws], ws))  # noqa: B905
    n, v, texts = sum(count.values()), len(count), held.count(False)
    for (k, ws), h in zip(tokens, held, strict=True):
        base, exact = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 0.0
        for t, u, w in zip([None, None, *ws], [None, *ws], ws):  # noqa: B905
            p = (pairs[u, w] + 4 * (count[w] + 1) / (n + v + 1)) / ((texts if u is None else count[u]) + 4)
            exact += math.log10((triples[t, u, w] + 4 * p) / ((texts if u is None else pairs[t, u]) + 4))
        yield k, h, len(ws), sum(count[w] > 0 for w in ws), n, base, exact


def test_lm(spark, folder):
    got = by_row(run(spark, "op9_log_frequency_scores", folder), "n_tokens")
    want = sorted(lm_by_hand(ODD), key=lambda r: (r[0] is None, r[0], r[2]))
    for r, w in zip(got.itertuples(), want, strict=True):
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[1:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9) and r.score < 0
        assert abs(r.score - w[6]) < 0.02 * abs(w[6]) + 0.001 * w[2]  # counts above 5 are quantised


def test_lm_however_dealt(spark, odd, monkeypatch):
    """Partitions, slices, segments and copies of hot segments don't change the result."""
    docs = odd.select("doc_id", "text", (F.col("doc_id") == 3).alias("held"))
    one = lm.lm_scores(docs, ["doc_id"], "text", "held").toPandas().sort_values(["doc_id", "n_tokens"])
    monkeypatch.setattr(lm, "SLICE", 3000)
    monkeypatch.setattr(lm, "ASKED", 50)
    monkeypatch.setattr(lm, "HELD", 700)
    for n in (1, 5):
        many = lm.lm_scores(docs.repartition(n), ["doc_id"], "text", "held", segment=20_000 // n).toPandas().sort_values(["doc_id", "n_tokens"])
        assert one.n_known.tolist() == many.n_known.tolist() and np.allclose(one.base_score, many.base_score)
        assert np.allclose(one.score, many.score, rtol=2e-3)  # other filters, other false positives


def test_lm_clashing_keys(spark, odd):
    docs = odd.select(F.lit(7).alias("held_out"), F.col("doc_id").alias("row"), F.lit("x").alias("slice"), "text", F.lit(False).alias("held"))
    got = lm.lm_scores(docs, ["held_out", "row", "slice"], "text", "held").toPandas()
    assert len(got) == len(ODD) and (got.held_out == 7).all() and not got.held_out_.any() and (got["slice"] == "x").all()


def test_packed_hashes():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        h = np.sort(r.integers(0, 2**64, n, dtype=np.uint64))
        assert (lm._unpacked_hashes(lm._packed_hashes(h), n) == h).all()
        ids = r.integers(0, 2**31, n).astype(np.int32)
        assert (lm._unpacked(lm._packed(ids), n) == ids).all()


def test_tokens_are_words():
    import pyarrow as pa

    texts = [" a B\x0bb", None, "", "ÄÖ a\x85b\u2003c  ", "\n\n"]
    hashes, check, ids, lengths = lm._tokens(pa.array(texts))
    want = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    named = {}
    for i, w in zip(ids.tolist(), (x for ws in want for x in ws), strict=True):
        assert named.setdefault(i, w) == w
    assert len(named) == len(set(named.values())) == len(hashes)


def test_tokens_with_one_first_hash():
    known, check = np.array([3, 5, 5, 9], dtype=np.uint64), np.array([1, 2, 7, 4], dtype=np.uint64)
    assert lm._places(known, check, np.array([5, 5, 9], dtype=np.uint64), np.array([7, 2, 4], dtype=np.uint64)).tolist() == [2, 1, 3]
    h, c, n = lm._merged(np.array([5, 3, 5, 5], dtype=np.uint64), np.array([7, 1, 2, 7], dtype=np.uint64), np.array([1, 1, 1, 1]))
    assert (h.tolist(), c.tolist(), n.tolist()) == ([3, 5, 5], [1, 2, 7], [1, 1, 2])


def test_lm_in_small_batches(spark):
    """Arrow batches end by the bytes of all columns; counts are those of a row's own tokens wherever they end."""
    rows = [(i, words(i % 97, 5 + i % 61)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "20000")
        got = lm.lm_scores(docs, ["doc_id"], "text", "held").toPandas().sort_values("doc_id")
    finally:
        spark.conf.set(key, before)
    tokens = [[*t.split(), "\n"] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if i % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    assert got.n_known.tolist() == [sum(count[w] > 0 for w in ws) for ws in tokens]
    assert np.allclose(got.base_score, [sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) for ws in tokens])


def test_log_frequency_filter():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**64, 5000, dtype=np.uint64)
    n = np.minimum(r.zipf(1.5, 5000), 10**6)
    f = lm.LogFrequencyFilter(lm.LogFrequencyFilter.build(h, n))
    level, got = lm.LogFrequencyFilter.levels(n), f.levels_of(h)
    assert lm.LogFrequencyFilter.levels(np.arange(8)).tolist() == [0, 1, 2, 3, 4, 5, 5, 6]
    assert lm.LogFrequencyFilter.value(np.array([0, 1, 4, 5, 6])).tolist() == [0, 1, 4, 5.5, 7.5]
    assert (got >= level).all()  # never too low
    assert (got == level).mean() > 0.99
    assert (f.levels_of(r.integers(0, 2**64, 5000, dtype=np.uint64)) > 0).mean() < 0.01


# --- 10


def places_by_hand(text, phrases):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [(label, i) for label, p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]


def test_licenses(spark, folder):
    got = by_row(run(spark, "op10_license_index", folder))
    want = sorted(ODD, key=lambda r: (r[0] is None, r[0]))
    for r, (_, t, *_) in zip(got.itertuples(), want, strict=True):
        n, places = places_by_hand(t, licenses.BASE)
        starts = [i for _, i in places]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(starts), ",".join(sorted({x for x, _ in places})))
        assert (r.first_word, r.last_word) == (min(starts), max(starts)) if starts else (r.first_word != r.first_word)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def license_by_hand(text, df, total):
    """Places and score of one text, every start of every template tried."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, score = [], 0.0
    weight = lambda x: math.log((total + 1) / (df[x] + 1)) + 1e-3
    for label, words, first, length, is_base in licenses._templates(licenses.TEXTS, licenses.BASE):
        for s in range(len(w)):
            if w[s : s + length] == words[first : first + length]:
                places.append((label, s, length, is_base))
                held = sum(weight(x) for i, x in enumerate(words) if 0 <= s - first + i < len(w) and w[s - first + i] == x)
                score = max(score, 0.5 if is_base else held / sum(map(weight, words)))
    return places, score


def test_license_templates(spark):
    full = {label: text for label, _, text in licenses.TEXTS}
    r = random.Random(8)
    pool = sorted({w for _, _, t in licenses.TEXTS for w in licenses._split(t)})
    texts = [*(t for _, _, t in licenses.TEXTS), "x mit permission is hereby granted free of charge y " + full["mit"].upper(), "free of charge", "GNU-Affero General Public License", "gnu general public gnu general public license", "mit license mit license", None, "", "cc by cc cc by by", full["gpl"] + full["lgpl"], "x " * 40_000 + full["zlib"]]
    texts += [" ".join(r.choice(pool) for _ in range(60)) + " " + " ".join(licenses._split(r.choice(licenses.TEXTS)[2])[r.randrange(9) :]) for _ in range(25)]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "places long, text string, id string"), ["places", "id"]).orderBy("places").collect()
    df = Counter(w for t in texts for w in set(re.findall(licenses.WORD, (t or "").translate(LOWER))))
    assert len(got) == len(texts) and got[0].asDict().keys() == {"places", "id", "n_words", "places_", "base_labels", "labels", "score"}
    for g, t in zip(got, texts, strict=True):
        places, score = license_by_hand(t, df, len(texts))
        assert sorted(map(tuple, g.places_)) == sorted(places) and g.score == pytest.approx(score, abs=1e-9)
        assert g.labels == ",".join(sorted({p[0] for p in places})) and g.base_labels == ",".join(sorted({p[0] for p in places if p[3]}))
