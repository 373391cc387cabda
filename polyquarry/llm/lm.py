"""Language-model scoring with a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyquarry.llm.common import cut, quoted, table, unlike
from polyquarry.llm.langid import held_out

END = b"\n"  # no word holds it
START_HASH = 0x2545F4914F6CDD1D
#: Bytes of text that are tokenised at once.
SLICE = 4 << 20
#: n-grams of one segment that a task looks up; a segment that is asked for more is copied to several tasks.
ASKED = 4 << 20
#: Turns in which slices ask for their n-grams, each for a part of the segments: what is shuffled for one is freed before the next.
TURNS = 2
#: Entries that a task counts before it sends them on.
HELD = 2 << 20


# --- tokens


def _slices(texts):
    """Row ranges of a batch that hold about SLICE bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    edges = [0, *(np.nonzero(np.diff((np.cumsum(size) - size) // SLICE))[0] + 1).tolist(), len(size)]
    return zip(edges, edges[1:], strict=False) if len(size) else ()


def _tokens(texts):
    """Of the distinct tokens, sorted, two hashes each; each token's place among them; tokens of each text (words, then one end).

    Tokens are told apart by both hashes, 64 and 32 bits; they are sorted by the first. ``texts``: an Arrow array; null: no words.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh3_128_digest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    runs, lengths = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
    ids, words = runs.indices.to_numpy(), runs.dictionary.cast(pa.binary())
    edges, data = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].tolist(), words.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    digests = [xxh3_128_digest(data[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    if (blank := runs.dictionary.index("").as_py()) >= 0:  # beside blanks at the ends of a text
        some = ids != blank
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
        ids = ids[some]
        ids = ids - (ids > blank)
        del digests[blank]
    ids = np.insert(ids, np.cumsum(lengths), len(digests))
    both = np.frombuffer(b"".join([*digests, xxh3_128_digest(END)]), dtype="<u8").reshape(-1, 2)
    order = np.argsort(both[:, 0], kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return both[order, 0], both[order, 1].astype("<u4"), place[ids], lengths + 1


def _distinct(h):
    """Sorted distinct values; by a sort, which is faster here than a hash table."""
    import numpy as np

    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _grams(hashes, ids, lengths, order: int):
    """Hash of each token with the ``order`` - 1 before it; before a text's first token stands START."""
    import numpy as np

    own = hashes[ids]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    h = own
    for _ in range(order - 1):
        before = np.empty_like(own)
        before[1:] = h[:-1]
        before[starts] = np.uint64(START_HASH)
        h = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (own + np.uint64(0x7F4A7C15))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def _cuts(sorted_hashes, bits: int):
    """Segments (by highest bits) that sorted hashes have entries in, where each starts, and the end."""
    import numpy as np

    seg = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.nonzero(np.diff(seg, prepend=-1))[0]
    return seg[starts], np.append(starts, len(seg))


def _places(known, check, asked, asked_check):
    """Where each asked token stands among the known ones, which hold all of them; both sorted by their first hash."""
    import numpy as np

    at = np.searchsorted(known, asked)
    off = np.nonzero(check[at] != asked_check)[0]
    for i in off.tolist():  # the first hash is shared by several tokens
        while check[at[i]] != asked_check[i]:
            at[i] += 1
    return at


def _merged(hashes, check, counts):
    """Distinct tokens sorted by both hashes, with their counts added up. ``check`` may be None."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = h[1:] != h[:-1]
    if check is not None and ((check[order[1:]] != check[order[:-1]]) & ~new).any():  # a first hash shared by several tokens
        order = np.lexsort((check, hashes))
        h = hashes[order]
        new = (h[1:] != h[:-1]) | (check[order[1:]] != check[order[:-1]])
    first = np.concatenate(([0], np.nonzero(new)[0] + 1)) if len(h) else np.empty(0, dtype=np.int64)
    total = np.add.reduceat(counts[order], first) if len(h) else counts
    return h[first], None if check is None else check[order[first]], total


def _narrow(values) -> bytes:
    """Numbers of 0 and more in the narrowest unsigned type that holds them all."""
    import numpy as np

    return values.astype(f"<u{next(w for w in (1, 2, 4, 8) if w == 8 or not int(values.max(initial=0)) >> 8 * w)}").tobytes()


def _widened(data: bytes, many: int):
    import numpy as np

    return np.frombuffer(data, dtype=f"<u{len(data) // many}").astype(np.int64)


def _packed(values) -> bytes:
    """Integers, compressed byte by byte."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data, many: int, kind: str = "<i4"):
    import numpy as np
    import pyarrow as pa

    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=wide * many, codec="zstd"), dtype=np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_hashes(sorted_hashes) -> bytes:
    """Sorted hashes as their differences, whose high bytes are empty."""
    import numpy as np

    return _packed(np.diff(sorted_hashes, prepend=np.uint64(0)))


def _unpacked_hashes(data, many: int):
    import numpy as np

    return np.cumsum(_unpacked(data, many, "<u8"), dtype=np.uint64)


# --- the filter


class LogFrequencyFilter:
    """Quantised counts of one segment's n-grams in a Bloom filter.

    Level k holds the counts from the k-th step on; steps grow by ``base``, by 1 at least, so small counts are exact. An n-gram is
    entered once for each level up to its count's. A query probes levels from 1 until one fails; what it passed is the
    count's level, never too low, too high only by false positives.
    """

    base, probes, bits_per_entry = 1.25, 5, 16

    def __init__(self, bits: bytes):
        import numpy as np

        self.bits = np.frombuffer(bits, dtype=np.uint8)

    @staticmethod
    def spots(h, level: int, probe: int, size: int):
        import numpy as np

        x = (h ^ np.uint64((level * 8 + probe + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) % np.uint64(size)

    @classmethod
    def steps(cls):
        import numpy as np

        made = [1]
        while len(made) < 126:
            made.append(max(made[-1] + 1, math.ceil(made[-1] * cls.base)))
        return np.array(made)

    @classmethod
    def levels(cls, counts):
        import numpy as np

        return np.searchsorted(cls.steps(), counts, side="right")

    @classmethod
    def value(cls, levels):
        """The middle of a level's counts; of level 0, 0."""
        import numpy as np

        edges = np.concatenate(([0, 1], cls.steps()[1:], [cls.steps()[-1] + 1]))
        return ((edges[:-1] + edges[1:] - 1) / 2)[levels] * (levels > 0)

    @classmethod
    def build(cls, h, counts) -> bytes:
        import numpy as np

        levels = cls.levels(counts)
        size = max(64, -(-int(levels.sum()) * cls.bits_per_entry // 8) * 8)
        on = np.zeros(size, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            part = h[levels >= level]
            for probe in range(cls.probes):
                on[cls.spots(part, level, probe, size)] = True
        return np.packbits(on, bitorder="little").tobytes()

    def levels_of(self, h):
        """The level that each n-gram seems to have."""
        import numpy as np

        levels, live, level = np.zeros(len(h), dtype=np.uint8), np.arange(len(h)), 0
        while len(live) and level < 126:
            level += 1
            for probe in range(self.probes):
                at = self.spots(h[live], level, probe, 8 * len(self.bits)).astype(np.int64)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            levels[live] = level
        return levels


# --- the operator


def lm_scores(docs: DataFrame, keys: list[str], text: str, held: str, kappa: float = 4.0, order: int = 3, segment: int = 4 << 20) -> DataFrame:
    """``keys``, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    The model is learned from rows whose boolean ``held`` is false (null counts as false). Tokens are the blank-separated words of the
    A-Z-lower-cased text (null: none), then one end. base_score adds log10((c + 1) / (N + V + 1)), c a token's count, N all and V
    distinct training tokens. score adds log10 of a token's probability given the ``order`` - 1 before it: from p, the base
    probability, on, p = (c' + kappa * p) / (n + kappa) for pairs, then triples, up to ``order``; c' is the n-gram's count, read from
    a log-frequency Bloom filter and cut to what is known of its parts, n that of the tokens before (of texts, at the start).

    Texts are tokenised once, into checkpointed slices of some MB: packed arrays under a number that all later joins use. Counts are
    kept in segments of the hash range, one for about each ``segment`` bytes of text, so that their sizes don't follow the corpus:
    tables of tokens (told apart by 96 bits) and a Bloom filter for the n-grams of each order. Tasks add up what they count before they send it,
    so a frequent n-gram reaches its segment once a task. Slices then ask the segments for their distinct n-grams;
    a segment that many ask is copied to several tasks. No broadcast and no work of the driver grows with the corpus
    but the list of segments that are copied (at most 12 bytes for each ASKED n-grams asked).

    Repeated rows stay; null keys are kept; empty tables give empty results. A key called like a new column keeps its name, the new
    column gets an underscore behind its own.
    """
    new = {n: unlike(n, keys) for n in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    docs = docs.select(F.struct(*(F.col(quoted(k)) for k in keys)).alias("row"), F.coalesce(F.col(quoted(held)), F.lit(False)).alias("held"), F.col(quoted(text)).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, (size // segment).bit_length())

    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def sliced(batches):
        """A slice as one row: its keys, its texts' lengths and parts in training, its tokens as places among its distinct ones."""
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        for batch in batches:
            for a, b in _slices(column(batch, "text")):
                part = batch.slice(a, b - a)
                hashes, check, ids, lengths = _tokens(column(part, "text"))
                train = ~column(part, "held").to_numpy(zero_copy_only=False).astype(bool)
                kept = pa.RecordBatch.from_arrays([column(part, "row"), column(part, "held")], names=["row", "held"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, kept.schema) as out:
                    out.write_batch(kept)
                blobs = [sink.getvalue().to_pybytes(), _packed_hashes(hashes), check.tobytes(), _packed(ids), lengths.tobytes(), train.astype(np.uint8).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], names=["slice", "keys", "hashes", "check", "ids", "lengths", "train"])
                number += 1

    # written once: batches and so slices may end elsewhere when the texts are read again
    slices = cut(docs.mapInArrow(sliced, "slice long, keys binary, hashes binary, check binary, ids binary, lengths binary, train binary"))

    def opened(batches):
        """Number, hashes, second hashes, ids, lengths and, for each token, whether it is in training."""
        import numpy as np

        kinds = {"check": np.uint32, "lengths": np.int64, "train": np.uint8}
        for batch in batches:
            for i in range(batch.num_rows):
                check, lengths, train = (np.frombuffer(column(batch, c)[i].as_buffer(), dtype=k) for c, k in kinds.items())
                ids = _unpacked(column(batch, "ids")[i].as_buffer(), int(lengths.sum()))
                hashes = _unpacked_hashes(column(batch, "hashes")[i].as_buffer(), len(check))
                yield column(batch, "slice")[i].as_py(), hashes, check, ids, lengths, np.repeat(train == 1, lengths)

    def counted(kind):
        """Training counts by segment, added up over a task's slices; and how many n-grams its slices will ask for."""

        def found(hashes, check, ids, lengths, train):
            """Distinct tokens or training n-grams with their counts; of all distinct n-grams, how many are in each segment."""
            import numpy as np

            if kind == 1:
                h, n, all_ = hashes, np.bincount(ids[train], minlength=len(hashes)), hashes
            else:
                grams = _grams(hashes, ids, lengths, kind)
                h, n = np.unique(grams[train], return_counts=True)
                all_ = _distinct(grams)
            return h, check, n, np.bincount((all_ >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            def send(parts):
                hashes, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
                check = None if kind > 1 else np.concatenate([p[1] for p in parts])
                asked = sum(p[3] for p in parts)
                h, check, n = _merged(hashes, check, counts.astype(np.int64))
                segs, cuts = _cuts(h, bits)
                ranges = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
                blobs = [[_packed_hashes(h[a:b]) for a, b in ranges], [check[a:b].tobytes() if check is not None else None for a, b in ranges], [_narrow(n[a:b]) for a, b in ranges]]
                numbers = (segs, asked[segs], np.diff(cuts))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(b, pa.binary()) for b in blobs)], names=["seg", "asked", "many", "hashes", "check", "counts"])

            parts = []
            for _, *of in opened(batches):
                parts.append(found(*of))
                if sum(len(p[0]) for p in parts) > HELD:
                    yield from send(parts)
                    parts = []
            if parts:
                yield from send(parts)

        return run

    def asks(kind, turn, turns):
        """Distinct n-grams of each slice, by segment; those of every ``turns``-th segment."""

        def run(batches):
            import pyarrow as pa

            for number, hashes, check, ids, lengths, _ in opened(batches):
                h, check = (hashes, check) if kind == 1 else (_distinct(_grams(hashes, ids, lengths, kind)), None)
                segs, cuts = _cuts(h, bits)
                now = segs % turns == turn
                ranges = list(zip(cuts[:-1][now].tolist(), cuts[1:][now].tolist(), strict=True))
                blobs = [[_packed_hashes(h[a:b]) for a, b in ranges], [check[a:b].tobytes() if check is not None else None for a, b in ranges]]
                numbers = ([number] * len(ranges), segs[now], (cuts[1:] - cuts[:-1])[now])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *(pa.array(b, pa.binary()) for b in blobs)], names=["slice", "seg", "many", "hashes", "check"])

        return run

    def built(kind):
        """A segment's table of tokens or filter of n-grams."""

        def run(t):
            import numpy as np
            import pyarrow as pa

            many = t["many"].to_pylist()
            h = np.concatenate([_unpacked_hashes(b, k) for b, k in zip(t["hashes"].to_pylist(), many, strict=True)])
            n = np.concatenate([_widened(b, k) for b, k in zip(t["counts"].to_pylist(), many, strict=True)])
            check = np.concatenate([np.frombuffer(b, dtype="<u4") for b in t["check"].to_pylist()]) if kind == 1 else None
            h, check, n = _merged(h, check, n)
            blob = b"".join(x.tobytes() for x in (h, check, n)) if kind == 1 else LogFrequencyFilter.build(h[n > 0], n[n > 0])
            made = [t["seg"][0].as_py(), sum(t["asked"].to_pylist()), len(h), blob, int(n.sum()), int((n > 0).sum())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.table({c: pa.array([v], k) for c, v, k in zip(("seg", "asked", "known", "held", "tokens", "types"), made, kinds, strict=True)})

        return run

    def answered(kind):
        """What a segment holds of each slice's n-grams: counts of tokens, levels of longer ones."""

        def run(asked, tables):
            import numpy as np
            import pyarrow as pa

            out, many = [], asked["many"].to_pylist()
            if asked.num_rows:  # all at once, since one slice asks a segment for few
                h = np.concatenate([_unpacked_hashes(b, k) for b, k in zip(asked["hashes"].to_pylist(), many, strict=True)])
                blob = tables["held"][0].as_buffer() if tables.num_rows else b"\0" * 8  # no n-gram in training
                if kind > 1:
                    found = LogFrequencyFilter(blob).levels_of(h)
                else:
                    n = tables["known"][0].as_py()
                    known, check, total = np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<u4", n, 8 * n), np.frombuffer(blob, "<i8", n, 12 * n)
                    found = total[_places(known, check, h, np.concatenate([np.frombuffer(b, dtype="<u4") for b in asked["check"].to_pylist()]))]
                ends = np.cumsum(many).tolist()
                out = [found[e - k : e].tobytes() if kind > 1 else _narrow(found[e - k : e]) for e, k in zip(ends, many, strict=True)]
            return pa.table({"slice": asked["slice"], "kind": pa.array([kind] * len(out), pa.int32()), "seg": asked["seg"], "many": asked["many"], "answer": pa.array(out, pa.binary())})

        return run

    def exchange(kind):
        """The segments, and what they answer each slice."""
        narrow = slices.select("slice", "hashes", "check", "ids", "lengths", "train")
        segments = cut(narrow.mapInArrow(counted(kind), "seg long, asked long, many long, hashes binary, check binary, counts binary").groupBy("seg").applyInArrow(built(kind), "seg long, asked long, known long, held binary, tokens long, types long"))
        copies = segments.select("seg", F.ceil(F.col("asked") / F.lit(ASKED)).cast("int").alias("copies"))
        hot = copies.where("copies > 1")  # one row for each ASKED n-grams asked, at most
        copy = F.pmod(F.xxhash64("slice"), F.coalesce("copies", F.lit(1)))
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("asked") / F.lit(ASKED)), F.lit(1)).cast("long") - 1)).alias("copy")
        tables = segments.select("seg", spread, "known", "held")
        found, turns = None, 1 if kind == 1 else TURNS
        for turn in range(turns):
            asked = narrow.mapInArrow(asks(kind, turn, turns), "slice long, seg long, many long, hashes binary, check binary")
            asked = asked.join(F.broadcast(hot), "seg", "left").select("slice", "seg", copy.cast("long").alias("copy"), "many", "hashes", "check")
            mine = tables.where(F.col("seg") % turns == turn).groupBy("seg", "copy")
            part = cut(asked.groupBy("seg", "copy").cogroup(mine).applyInArrow(answered(kind), "slice long, kind int, seg long, many long, answer binary"))
            found = part if found is None else found.unionByName(part)
        return segments, found

    ones, counts = exchange(1)
    n_all, n_types = ones.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    replies = counts
    for kind in range(2, order + 1):
        replies = replies.unionByName(exchange(kind)[1])

    def score(part, replies):
        import numpy as np
        import pyarrow as pa

        made = pa.ipc.open_stream(part["keys"][0].as_py()).read_all()
        lengths = np.frombuffer(part["lengths"][0].as_py(), dtype=np.int64)
        ids = _unpacked(part["ids"][0].as_buffer(), int(lengths.sum()))
        by_seg = sorted(zip(*(replies[c].to_pylist() for c in ("kind", "seg", "many", "answer")), strict=True))
        counts = np.concatenate([_widened(b, n) for k, _, n, b in by_seg if k == 1])
        steps = LogFrequencyFilter.value(np.arange(127))
        hashes = _unpacked_hashes(part["hashes"][0].as_buffer(), len(counts))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        texts = counts[ids[-1]]  # each text ends once: the number of training texts
        c = counts[ids]
        base = (c + 1) / (n_all + n_types + 1)
        p, seen = base, c.astype(np.float64)
        for kind in range(2, order + 1):
            levels = np.frombuffer(b"".join(b for k, _, _, b in by_seg if k == kind), dtype=np.uint8)
            n = np.empty_like(seen)
            n[1:] = seen[:-1]
            n[starts] = texts
            _, gram = np.unique(_grams(hashes, ids, lengths, kind), return_inverse=True)
            seen = np.minimum(steps[levels[gram]], np.minimum(seen, n))
            p = (seen + kappa * p) / (n + kappa)
        values = {
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
            "base_score": pa.array(np.add.reduceat(np.log10(base), starts)),
            "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        }
        for name, value in values.items():
            made = made.append_column(name, value)
        return made

    packed = slices.select("slice", "keys", "hashes", "ids", "lengths")
    schema = T.StructType([docs.schema["row"], docs.schema["held"]])
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())):
        schema = schema.add(name, kind)
    out = packed.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(score, schema)
    out = out.withColumn("train_tokens", F.lit(int(n_all)).cast("long")).withColumnRenamed("held", "held_out")
    return out.select("row.*", *(F.col(c).alias(n) for c, n in new.items()))


def op9_log_frequency_scores(spark, sf_dir):
    """All documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held"))
    return lm_scores(docs, ["doc_id"], "text", "held")


QUERIES = {"op9_log_frequency_scores": op9_log_frequency_scores}
ORACLES: dict[str, str] = {}
