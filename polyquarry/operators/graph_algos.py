"""Graph algorithms as joins and aggregates over an edge table (src, dst[, weight]).

State lives in DataFrames, cut by ``checkpoint`` each round; the driver sees one number a round. Edges are given as they are:
parallel edges count where noted. ``vertices`` (id) may add isolated nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.session import checkpoint

#: Most links that a task may hold, 16 bytes each. Of larger graphs all-pairs searches advance by joins, layer by layer.
MOST_HELD = 1 << 23


def _kept_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once, dealt and sorted by ``key``: the joins of all rounds on it leave it where it is."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartition(parts, key).sortWithinPartitions(key), dealt=True)


def _lightest(edges: DataFrame, weight: str) -> DataFrame:
    """src, dst, w, kept by src: of parallel edges the lightest, a missing weight is 1."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = edges.select("src", "dst", F.coalesce(F.col(weight), F.lit(1.0)).alias("w")).repartition(parts, "src")
    return checkpoint(own.groupBy("src", "dst").agg(F.min("w").alias("w")).sortWithinPartitions("src"), dealt=True)


def vertices_of(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))  # edges are read once
    return (ids if vertices is None else ids.union(vertices.select("id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once (a < b), no loops."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, in_degree, out_degree, degree; parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    if vertices is not None:
        ends = ends.union(vertices.select("id", F.lit(0), F.lit(0)))
    out = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-4) -> DataFrame:
    """id, rank: dangling mass is spread evenly, parallel edges count, ranks add up to 1. Stops when no rank moves by ``tolerance``."""
    nodes = checkpoint(vertices_of(edges, vertices))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(None).cast("double"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    # parallel edges are one row with a share
    shares = _kept_by(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, F.col("src") == F.col("id")).select("src", "dst", (F.col("m") / F.col("out")).alias("share")), "src")
    linked = out.select("id", F.lit(True).alias("linked"))
    state = checkpoint(nodes.join(linked, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        dangling = state.where(~F.col("linked")).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = shares.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / n + damping * dangling / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        moved = checkpoint(state.join(got, "id", "left").select("id", "linked", new.alias("rank"), F.abs(new - F.col("rank")).alias("step")))
        state = moved.drop("step")
        if tolerance is not None and moved.agg(F.max("step")).first()[0] < tolerance:
            break
    total = state.agg(F.sum("rank")).first()[0]
    return state.select("id", (F.col("rank") / F.lit(total)).alias("rank"))


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, component: the least id reachable when directions are ignored.

    Each round nodes point to their least neighbour, pointers are doubled until they lead to roots, and edges are contracted, so
    components at least halve a round, chains included.
    """
    live = checkpoint(undirected(edges))
    labels = checkpoint(vertices_of(edges, vertices).withColumn("component", F.col("id")))
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        to = checkpoint(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("to")))
        while True:
            further = to.select(F.col("n").alias("to"), F.col("to").alias("on"))
            moved = checkpoint(to.join(further, "to", "left").select("n", F.coalesce("on", "to").alias("to"), (F.col("on") < F.col("to")).alias("moved")))
            to = moved.select("n", "to")
            if moved.where("moved").isEmpty():
                break
        labels = checkpoint(labels.join(to, labels["component"] == to["n"], "left").select("id", F.coalesce("to", "component").alias("component")))
        moved = live.join(to.select(F.col("n").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("n").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        live = checkpoint(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return labels


def component_count(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    return components(edges, vertices).agg(F.countDistinct("component").alias("components"))


#: About the most pairs that a task closes triangles among.
MOST_PAIRS = 1 << 20


def triangles(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, triangles: undirected, without loops and parallels."""
    return _triangles(checkpoint(undirected(edges)), vertices_of(edges, vertices))


def _triangles(pairs: DataFrame, nodes: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Triangles of checkpointed ``pairs`` (a, b).

    Nodes have one of p colours, and each multiset of three colours is a task that gets the pairs of its colours: a pair travels p
    times, no wedge does, and a task holds about ``most`` pairs. There pairs point from the smaller to the larger degree, so a
    hub closes triangles but seldom opens wedges.
    """
    count = pairs.count()
    p = max(4, math.ceil(math.sqrt(6 * count / most)))
    colour = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(p)).cast("int")
    three = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda c: F.array_sort(F.array("x", "y", c)))
    dealt = pairs.withColumns({"x": colour("a"), "y": colour("b")}).select("a", "b", "x", "y", F.explode(three).alias("t"))
    dealt = dealt.select("a", "b", "x", "y", *(F.col("t")[i].alias(f"t{i}") for i in range(3)))
    kind = pairs.schema["a"].dataType.simpleString()

    def close(key, part):
        import numpy as np
        import pyarrow as pa

        first, _, last = (x.as_py() for x in key)
        ids = pa.chunked_array([*part["a"].chunks, *part["b"].chunks], type=part.schema.field("a").type).combine_chunks().dictionary_encode()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        codes, n = ids.indices.to_numpy().astype(np.int64), len(ids.dictionary)
        colours = np.zeros(n, dtype=np.int32)
        colours[codes] = np.concatenate([part["x"].to_numpy(), part["y"].to_numpy()])
        order = np.argsort(np.bincount(codes, minlength=n), kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        u, v = rank[codes[: len(codes) // 2]], rank[codes[len(codes) // 2 :]]
        keys = np.sort(np.minimum(u, v) * n + np.maximum(u, v))
        u, v, colours = keys // n, keys % n, colours[order]
        more = np.searchsorted(u, u, "right") - np.arange(len(u)) - 1  # later pairs of the same node
        before, counts, at = np.cumsum(more) - more, np.zeros(n, dtype=np.int64), 0
        while at < len(u):
            to = max(at + 1, int(np.searchsorted(before, before[at] + (1 << 21))))
            m = more[at:to]
            one = np.repeat(np.arange(at, to), m)
            two = one + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wanted = v[one] * n + v[two]
            place = np.searchsorted(keys, wanted)
            closed = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == wanted)
            corners = np.stack([u[one[closed]], v[one[closed]], v[two[closed]]])
            if first != last:  # those of a single colour have a task of their own
                c = colours[corners]
                corners = corners[:, (c[0] != c[1]) | (c[1] != c[2])]
            counts += np.bincount(corners.ravel(), minlength=n)
            at = to
        some = np.flatnonzero(counts)
        return pa.table({"id": ids.dictionary.take(pa.array(order[some])), "n": pa.array(counts[some])})

    counts = dealt.groupBy("t0", "t1", "t2").applyInArrow(close, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return nodes.join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def clustering(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, lcc: 2 t / (d (d - 1)); 0 below two neighbours."""
    pairs = checkpoint(undirected(edges))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    joined = _triangles(pairs, vertices_of(edges, vertices)).join(degree, "id", "left")
    lcc = F.when(F.col("d") > 1, 2.0 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return joined.select("id", lcc.alias("lcc"))


def sorted_positions(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the rows' numbers from 0 in the order of ``column``, by a range partitioning instead of one task's sort.

    The driver sees one count a partition.
    """
    dealt = checkpoint(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(dealt.groupBy(part.alias("p")).count().collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _first long"))  # a row for each partition
    return dealt.join(first, part == F.col("_p")).withColumn(out, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_first")


def cdlp(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 10) -> DataFrame:
    """id, community: synchronous label propagation over exactly ``rounds`` rounds.

    Every directed edge counts as a neighbour at both ends, loops don't; the most frequent label wins, the least of them on
    ties. Labels are renumbered from 0 in their order.
    """
    state = checkpoint(vertices_of(edges, vertices).withColumn("label", F.col("id")))
    near = edges.where("src <> dst").select("src", "dst")
    near = checkpoint(near.union(near.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").alias("m")))
    for _ in range(rounds):
        votes = near.join(state.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.sum("m").alias("n"))
        # the least label among the most frequent: one aggregate, no sort
        best = votes.groupBy("src").agg(F.max("n").alias("top")).join(votes, "src").where("n = top").groupBy("src").agg(F.min("label").alias("best"))
        state = checkpoint(state.join(best, state["id"] == best["src"], "left").select("id", F.coalesce("best", "label").alias("label")))
    numbers = sorted_positions(state.select("label").distinct(), "label", "community")
    return state.join(numbers, "label").select("id", F.col("community").cast("long").alias("community"))


def label_propagation(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 20, seed: int = 1) -> DataFrame:
    """id, community (least member): half of the nodes, chosen by a seeded hash, adopt their neighbours' most frequent label each round."""
    state = checkpoint(vertices_of(edges, vertices).withColumn("label", F.col("id")))
    near = checkpoint(undirected(edges))
    near = _kept_by(near.union(near.select("b", "a")), "b")
    parts = near.rdd.getNumPartitions()
    for number in range(rounds):
        # votes travel once, to the node that counts them
        votes = near.join(state.withColumnRenamed("id", "b"), "b").select("a", "label").repartition(parts, "a").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct("n", F.xxhash64("label", F.lit(seed)))).alias("best"))
        turn = F.pmod(F.xxhash64("id", F.lit(seed + number)), F.lit(2)) == 0
        moved = checkpoint(state.join(best, state["id"] == best["a"], "left").select("id", F.when(turn, F.coalesce("best", "label")).otherwise(F.col("label")).alias("new"), "label"))
        changed = moved.where("new <> label").isEmpty()
        state = moved.select("id", F.col("new").alias("label"))
        if changed and number:
            break
    least = state.groupBy("label").agg(F.min("id").alias("community"))
    return state.join(least, "label").select("id", "community")


def louvain(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 12, seed: int = 1, levels: int = 10) -> DataFrame:
    """id, community (least member): local moving for modularity, resolution 1, then the communities as nodes of a smaller graph, until no more move.

    Nodes move to the neighbouring community with the highest positive gain; a seeded half of them moves each round, so that
    neighbours don't swap for ever. The result is a partition of good modularity, not a unique labelling.
    """
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))
    near = checkpoint(pairs.union(pairs.select("b", "a", "w")))
    total = near.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    strength = near.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    nodes = checkpoint(vertices_of(edges, vertices).join(strength, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")))
    member = nodes.select("id", F.col("id").alias("c"))
    for level in range(levels if total else 0):
        moved = _local_moving(near, nodes, total, rounds, seed + 100 * level)
        if moved.where("id <> c").isEmpty():
            break
        to = moved.select(F.col("id").alias("c"), F.col("c").alias("to"))
        member = checkpoint(member.join(to, "c").select("id", F.col("to").alias("c")))
        nodes = checkpoint(moved.groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")))
        ends = near.join(to.withColumnsRenamed({"c": "a", "to": "x"}), "a").join(to.withColumnsRenamed({"c": "b", "to": "y"}), "b")
        # edges inside a community weigh in its strength, but draw it nowhere
        near = checkpoint(ends.where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
    least = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(least, "c").select("id", "community")


def _local_moving(near: DataFrame, nodes: DataFrame, total: float, rounds: int, seed: int) -> DataFrame:
    """id, k, c: the communities after moves of single nodes that raise modularity. ``near``: a, b, w in both directions."""
    state, quiet = checkpoint(nodes.select("id", "k", F.col("id").alias("c"))), 0
    near = _kept_by(near, "b")
    parts = near.rdd.getNumPartitions()
    for number in range(rounds):
        size = state.groupBy("c").agg(F.sum("k").alias("s"))
        own = state.select("id", "k", F.col("c").alias("own"))
        # a link carries its end's community and that community's strength, and travels once
        sent = near.join(state.join(size, "c").select(F.col("id").alias("b"), "c", "s"), "b").select(F.col("a").alias("id"), "c", "s", "w")
        links = sent.repartition(parts, "id").groupBy("id", "c").agg(F.sum("w").alias("to"), F.first("s").alias("s")).join(own, "id")
        # gain of being in c, its own strength left out of its present community
        gain = F.col("to") - F.col("k") * (F.col("s") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        best = links.withColumn("gain", gain).groupBy("id").agg(F.max_by(F.struct("c", "gain"), F.struct("gain", "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        turn = F.pmod(F.xxhash64("id", F.lit(seed + number)), F.lit(2)) == 0
        # alone in its community a node gains nothing by staying, elsewhere it loses its strength's share
        better = turn & (F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12)
        moved = checkpoint(state.join(best, "id", "left").select("id", "k", F.when(better, F.col("best.c")).otherwise(F.col("c")).alias("new"), "c"))
        quiet = quiet + 1 if moved.where("new <> c").isEmpty() else 0
        state = moved.select("id", "k", F.col("new").alias("c"))
        if quiet == 2:
            break
    return state


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    pairs = edges.where("src <> dst")
    c = communities.select(F.col("id"), F.col("community"))
    both = pairs.join(c.withColumnsRenamed({"id": "src", "community": "x"}), "src").join(c.withColumnsRenamed({"id": "dst", "community": "y"}), "dst")
    m = both.count()
    inside = both.where("x = y").groupBy(F.col("x").alias("community")).agg(F.count("*").alias("i"))
    ends = both.select(F.explode(F.array("x", "y")).alias("community")).groupBy("community").agg(F.count("*").alias("d"))
    row = ends.join(inside, "community", "left").agg(F.sum(F.coalesce("i", F.lit(0)) / F.lit(m) - F.pow(F.col("d") / F.lit(2.0 * m), 2))).first()
    return row[0]


# --- distances


def bfs(edges: DataFrame, sources: DataFrame, vertices: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """source, id, distance: fewest hops along directions from each row of ``sources`` (id). Unreachable nodes are absent."""
    links = checkpoint(edges.where("src <> dst").select("src", "dst").distinct())
    seen = checkpoint(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    front, step = seen, 0
    while most is None or step < most:
        step += 1
        reached = front.join(links, front["id"] == links["src"]).select("source", F.col("dst").alias("id")).distinct()
        front = checkpoint(reached.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front))
    return seen


def _searches(nodes: DataFrame, links: DataFrame, starts: DataFrame, search, schema: str) -> DataFrame:
    """Rows (n, ...) of ``search`` from every row of ``starts`` (id), n given back as ``id``; blocks of starts share tasks.

    ``search(size, first, target, times, sources)`` sees the whole graph by numbers from 0: the links of node n are
    ``target[first[n] : first[n + 1]]``, ``times`` their parallels. Links travel to each block in packed runs, at most ``MOST_HELD``.
    """
    spark = nodes.sparkSession
    numbers = checkpoint(sorted_positions(nodes, "id", "n").select("id", F.col("n").cast("int").alias("n")))
    size, blocks = numbers.count(), 3 * spark.sparkContext.defaultParallelism
    ends = links.join(numbers.withColumnsRenamed({"id": "src", "n": "a"}), "src").join(numbers.withColumnsRenamed({"id": "dst", "n": "b"}), "dst").select("a", "b", "m")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns], names=["a", "b", "m"])

    # a row for each block
    packed = ends.mapInArrow(pack, "a binary, b binary, m binary").crossJoin(F.broadcast(spark.range(blocks).select(F.col("id").cast("int").alias("block"))))
    chosen = starts.select("id").join(numbers, "id").select("n", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("block"))

    def run(left, right):
        import numpy as np

        whole = lambda name, kind: np.frombuffer(b"".join(right[name].to_pylist()), dtype=kind)
        a = whole("a", np.int32)
        order = np.argsort(a, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=size))))
        return search(size, first, whole("b", np.int32)[order], whole("m", np.float64)[order], np.sort(left["n"].to_numpy()))

    found = chosen.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(run, schema)
    return found.join(numbers, "n").drop("n")


def _out_of(nodes, first):
    """Places of all links that leave ``nodes``, and the node of each."""
    import numpy as np

    count = first[nodes + 1] - first[nodes]
    return np.arange(count.sum()) + np.repeat(first[nodes] - (np.cumsum(count) - count), count), np.repeat(nodes, count)


def _reach(size, first, target, times, sources):
    """How many nodes each source reaches and the sum of their distances; 64 sources advance in the bits of a word."""
    import numpy as np
    import pyarrow as pa

    back = np.argsort(target, kind="stable")
    source_of, into = np.repeat(np.arange(size), np.diff(first))[back], np.bincount(target, minlength=size)
    into_some = np.flatnonzero(into)
    into_first = (np.cumsum(into) - into)[into_some]
    many, far = [], []
    for at in range(0, len(sources), 64):
        part = sources[at : at + 64]
        bits = np.zeros(size, dtype=np.uint64)
        bits[part] = np.uint64(1) << np.arange(len(part), dtype=np.uint64)
        seen, live, step = bits.copy(), part, 0
        n, d = np.zeros(64, dtype=np.int64), np.zeros(64, dtype=np.int64)
        while len(live):
            step += 1
            new = np.zeros(size, dtype=np.uint64)
            places, u = _out_of(live, first)
            if 8 * len(places) > len(target):
                new[into_some] = np.bitwise_or.reduceat(bits[source_of], into_first)
            elif len(places):  # few links: only these
                w = target[places]
                order = np.argsort(w, kind="stable")
                w = w[order]
                starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                new[w[starts]] = np.bitwise_or.reduceat(bits[u[order]], starts)
            new &= ~seen
            seen |= new
            bits, live = new, np.flatnonzero(new)
            each = np.unpackbits(new[live].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n, d = n + each, d + step * each
        many.append(n[: len(part)])
        far.append(d[: len(part)])
    joined = lambda x: pa.array(np.concatenate([np.empty(0, dtype=np.int64), *x]))
    return pa.table({"n": pa.array(sources.astype(np.int32)), "many": joined(many), "d": joined(far)})


def _dependencies(size, first, target, times, sources):
    """Brandes' sums of dependencies of all nodes on the sources."""
    import numpy as np
    import pyarrow as pa

    sums = np.zeros(size)
    for s in sources:
        paths, seen, front, layers = np.zeros(size), np.zeros(size, dtype=bool), np.array([s]), []
        paths[s], seen[s] = 1.0, True
        while len(front):
            places, u = _out_of(front, first)
            w = target[places]
            new = ~seen[w]
            u, w, m = u[new], w[new], times[places[new]]
            got = np.bincount(w, paths[u] * m, minlength=size)
            front = np.flatnonzero(got)
            # only ratios between layers count, so numbers of paths beyond doubles are scaled
            scale = got.max() if got.max() > 1e100 else 1.0
            paths[front], seen[front] = got[front] / scale, True
            layers.append((u, w, m / scale))
        delta = np.zeros(size)
        for u, w, m in reversed(layers):
            delta += np.bincount(u, paths[u] * m / paths[w] * (1.0 + delta[w]), minlength=size)
        delta[s] = 0.0
        sums += delta
    kept = np.flatnonzero(sums)
    return pa.table({"n": pa.array(kept.astype(np.int32)), "b": pa.array(sums[kept])})


def closeness(edges: DataFrame, vertices: DataFrame | None = None, held: int = MOST_HELD) -> DataFrame:
    """id, closeness: Wasserman and Faust's, over out-edges; 0 if nothing is reachable.

    Exact for every node. Up to ``held`` links a task searches the whole graph from a block of nodes; beyond, layers are joined.
    """
    nodes = checkpoint(vertices_of(edges, vertices))
    total = nodes.count()
    links = checkpoint(edges.where("src <> dst").select("src", "dst").distinct())
    if total < 1 << 31 and links.count() <= held:
        far = _searches(nodes, links.withColumn("m", F.lit(1.0)), nodes, _reach, "n int, many long, d long").select("id", F.col("many").alias("n"), "d")
    else:
        far = bfs(links, nodes).where("distance > 0").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.sum("distance").alias("d"))
    value = F.when(F.col("d") > 0, F.col("n") / F.lit(max(1, total - 1)) * F.col("n") / F.col("d")).otherwise(0.0)
    return nodes.join(far, "id", "left").select("id", value.alias("closeness"))


def betweenness(edges: DataFrame, vertices: DataFrame | None = None, sources: int | None = None, seed: int = 1, held: int = MOST_HELD) -> DataFrame:
    """id, betweenness: Brandes on the directed, unweighted graph, divided by (N - 1)(N - 2); parallel edges multiply paths.

    ``sources``: paths from about so many nodes only, chosen by a seeded hash, scaled to all. The work falls from N to that many
    searches; the error of a value b in 0..1 is then about sqrt(b (1 - b) / sources), without bias. Exact without it.

    Up to ``held`` links a task searches the whole graph from a block of sources. Beyond, all sources advance together: (source, node,
    distance, paths) rows grow layer by layer, then dependencies run back, with memory bounded by partitions. Nothing is held on the driver.
    """
    nodes = checkpoint(vertices_of(edges, vertices))
    total = nodes.count()
    if total <= 2:
        return nodes.withColumn("betweenness", F.lit(0.0))
    links = checkpoint(edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("m")))
    starts, share = nodes, 1.0
    if sources is not None and sources < total:
        starts = checkpoint(nodes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(sources / total * (1 << 30)))))
        share = max(1, starts.count()) / total
    scale = 1.0 / ((total - 1) * (total - 2)) / share
    if total < 1 << 31 and links.count() <= held:
        got = _searches(nodes, links, starts, _dependencies, "n int, b double").groupBy("id").agg(F.sum("b").alias("b"))
        return nodes.join(got, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
    layers = [checkpoint(starts.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    seen = layers[0].select("s", "v")
    while True:
        last = layers[-1]
        reached = last.join(links, last["v"] == links["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        front = checkpoint(reached.join(seen, ["s", "v"], "left_anti"))
        if front.isEmpty():
            break
        layers.append(front)
        seen = checkpoint(seen.union(front.select("s", "v")))
    sums = None
    below = layers[-1].select("s", "v", "paths", F.lit(0.0).alias("delta"))
    for layer in reversed(layers[:-1]):
        gone = below.select("s", F.col("v").alias("w"), F.col("paths").alias("wp"), "delta")
        given = layer.join(links, layer["v"] == links["src"]).select("s", "v", "paths", F.col("dst").alias("w"), "m").join(gone, ["s", "w"])
        part = given.groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("m") / F.col("wp") * (1.0 + F.col("delta"))).alias("delta"))
        below = checkpoint(layer.join(part, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        own = below.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("b"))
        sums = own if sums is None else sums.union(own)
    got = sums.groupBy("id").agg(F.sum("b").alias("b")) if sums is not None else nodes.select("id", F.lit(0.0).alias("b"))
    return nodes.join(got, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def sssp(edges: DataFrame, source, weight: str = "weight", rounds: int | None = None) -> DataFrame:
    """id, distance: least sum of weights from ``source``; a missing weight is 1, of parallel edges the lightest counts. Unreachable nodes are absent.

    A cycle of negative weight within reach raises: then distances still shrink after as many rounds as there are nodes.
    """
    return _sssp(_lightest(edges, weight), source, rounds)


def _sssp(links: DataFrame, source, rounds: int | None = None) -> DataFrame:
    """``sssp`` over ``links`` as ``_lightest`` gives them."""
    kind = links.schema["src"].dataType
    best = checkpoint(links.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0.0).alias("distance")))
    front, step = best, 0
    negative = vertices_of(links).count() if not links.where("w < 0").isEmpty() else 0
    while rounds is None or step < rounds:
        step += 1
        offers = front.join(links, front["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("offer"))
        # only nodes that got nearer pass on
        front = checkpoint(offers.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("offer") < F.col("distance"))).select("id", F.col("offer").alias("distance")))
        if front.isEmpty():
            break
        if negative and step > negative:
            raise ValueError("a cycle of negative weight")
        best = checkpoint(best.union(front).groupBy("id").agg(F.min("distance").alias("distance")))
    return best


def shortest_paths(edges: DataFrame, start, end, most: int | None = None, every: bool = True) -> DataFrame:
    """path (array of ids), hops: all (or one) of the paths with fewest hops from ``start`` to ``end``."""
    links = checkpoint(edges.where("src <> dst").select("src", "dst").distinct())
    kind = edges.schema["src"].dataType
    start_, end_ = F.lit(start).cast(kind), F.lit(end).cast(kind)
    paths = edges.sparkSession.range(1).select(F.array(start_).alias("path"))
    seen, step = paths.select(F.col("path")[0].alias("id")), 0
    while True:
        hit = paths.where(F.element_at("path", -1) == end_)
        if not hit.isEmpty():
            out = hit.select("path", (F.size("path") - 1).alias("hops"))
            return out if every else out.orderBy("path").limit(1)
        if most is not None and step >= most:
            return paths.limit(0).select("path", F.lit(0).alias("hops"))
        step += 1
        longer = paths.join(links, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"))
        paths_ = checkpoint(longer.join(seen, "id", "left_anti"))
        if paths_.isEmpty():
            return paths_.limit(0).select("path", F.lit(0).alias("hops"))
        seen = checkpoint(seen.union(paths_.select("id").distinct()))
        paths = paths_.select("path")


def k_shortest_paths(edges: DataFrame, start, end, k: int, weight: str = "weight") -> DataFrame:
    """path, cost: the k cheapest loopless paths, ties in order of the path.

    Partial paths are grown best first in rounds: those whose cost plus exact distance left to ``end`` is within a bound are
    extended, the others wait; the bound rises to the waiting ones until k paths are complete. All paths within the
    bound have then been seen, so the k best are exact.
    """
    links = _lightest(edges.where("src <> dst"), weight)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    left = checkpoint(sssp(back, end, "w").withColumnsRenamed({"distance": "left"}))
    kind = edges.schema["src"].dataType
    end_ = F.lit(end).cast(kind)
    waiting = edges.sparkSession.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(0.0).alias("cost"), F.lit(start).cast(kind).alias("id"))
    waiting = checkpoint(waiting.join(left, "id").select("path", "cost", "id", F.col("left").alias("least")))
    done = waiting.where(F.col("id") == end_).select("path", "cost")
    waiting = waiting.where(F.col("id") != end_)
    while True:
        found = done.count()
        bound = waiting.orderBy("least").limit(max(0, k - found)).agg(F.max("least")).first()[0]
        if bound is None:
            return done.orderBy("cost", "path").limit(k)
        live, waiting = waiting.where(F.col("least") <= bound), waiting.where(F.col("least") > bound)
        while not live.isEmpty():
            longer = live.join(links, live["id"] == links["src"]).where(~F.array_contains("path", F.col("dst")))
            longer = longer.select(F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("w")).alias("cost"), F.col("dst").alias("id")).join(left, "id")
            grown = checkpoint(longer.select("path", "cost", "id", (F.col("cost") + F.col("left")).alias("least")))
            done = done.union(grown.where(F.col("id") == end_).select("path", "cost"))
            open_ = grown.where(F.col("id") != end_)
            live, waiting = open_.where(F.col("least") <= bound), waiting.union(open_.where(F.col("least") > bound))
        done, waiting = checkpoint(done), checkpoint(waiting)


def a_star(edges: DataFrame, start, end, weight: str = "weight", heuristic: DataFrame | None = None) -> DataFrame:
    """path, cost of a cheapest path. ``heuristic`` (id, estimate), admissible, prunes nodes that can't be on a better path."""
    links = _lightest(edges, weight)
    far = _sssp(links, start)
    goal = far.where(F.col("id") == F.lit(end)).first()
    if goal is None:
        return edges.sparkSession.createDataFrame([], f"path array<{edges.schema['src'].dataType.simpleString()}>, cost double")
    if heuristic is not None:
        far = far.join(heuristic, "id", "left").where(F.col("distance") + F.coalesce("estimate", F.lit(0.0)) <= goal.distance + 1e-9).drop("estimate")
    far = checkpoint(far)
    # edges that lie on cheapest paths; walk back from the end
    tight = links.join(far.withColumnsRenamed({"id": "src", "distance": "ds"}), "src").join(far.withColumnsRenamed({"id": "dst", "distance": "dd"}), "dst").where(F.abs(F.col("ds") + F.col("w") - F.col("dd")) < 1e-9)
    tight = checkpoint(tight.groupBy("dst").agg(F.min("src").alias("src")))
    path = far.where(F.col("id") == F.lit(end)).select(F.array("id").alias("path"), F.col("distance").alias("cost"))
    while path.where(F.col("path")[0] != F.lit(start)).count():
        path = checkpoint(path.join(tight, F.col("path")[0] == F.col("dst")).select(F.concat(F.array("src"), "path").alias("path"), "cost"))
        if path.isEmpty():
            break
    return path


def write_back(nodes: DataFrame, values: DataFrame, column: str, name: str) -> DataFrame:
    """``nodes`` with an algorithm's result as a top-level property of their JSON."""
    from polyquarry.functions import jsonops

    got = values.select("id", F.col(column).alias("_value"))
    joined = nodes.join(got, "id", "left")
    patch = F.to_json(F.struct(F.col("_value").alias(name)))
    return joined.withColumn("properties", F.when(F.col("_value").isNotNull(), jsonops.merge(F.coalesce("properties", F.lit("{}")), patch)).otherwise(F.col("properties"))).drop("_value")
