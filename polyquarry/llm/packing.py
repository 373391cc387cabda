"""Best-fit-decreasing packing of token pieces into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import cut, quoted, table, unlike, with_positions

CONTEXT = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"


# --- tokens

#: Bytes of text that are tokenised at once.
SLICE = 16 << 20
#: ASCII signs that may follow a word's letters; an apostrophe may begin a token of its own, so it is not among them.
SIGNS = r"[!-&(-@\[-`{-~]"


def plain_letters() -> str:
    """Letters that the normaliser maps one to one to letters and that never join with what follows: Latin up to U+024F."""
    from unicodedata import normalize

    latin = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha()]
    return "".join(c for c in latin if normalize("NFC", c) == c and normalize("NFC", c.lower()) == c.lower())


class TextIds:
    """Token ids of whole texts, tokenised once for each distinct run of characters between blanks.

    The vocabulary's tokeniser never joins characters across white space, so the ids of a text are those of its runs in
    order; and letters followed by ASCII signs are the ids of the letters, then those of the signs. Texts are split and
    their runs told apart by Arrow, only distinct words meet the tokeniser, and ids are gathered by numpy. Nothing is kept
    from one call to the next.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary)
        # words of plain letters come lower-cased and apart, so normalising and splitting them again is spared
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parted = f"^([{plain_letters()}]*)({SIGNS}*)$"

    def _encoded(self, encodings):
        """Ids one after another, and how many each has."""
        import numpy as np

        parts = [np.array(e.ids, dtype="<u4") for e in encodings]
        return np.concatenate([np.empty(0, dtype="<u4"), *parts]), np.array([len(p) for p in parts], dtype=np.int64)

    def _whole(self, runs: list[str]):
        return self._encoded(self.whole.encode_batch_fast(runs, add_special_tokens=False))

    def _words(self, words: list[str]):
        """Ids of words of plain letters, some words a call; their ends are told by the ids."""
        import numpy as np

        joined = [" ".join(words[i : i + 16]) for i in range(0, len(words), 16)]
        ids, _ = self._encoded(self.words.encode_batch_fast(joined, add_special_tokens=False))
        ends = np.nonzero(self.last[ids])[0] + 1
        if len(ends) != len(words):
            raise ValueError("the tokeniser's words don't end in ids of their own")
        return ids, np.diff(ends, prepend=0)

    def _of_runs(self, runs):
        """Ids of distinct runs: all ids, and of each run where its ids start and how many they are."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # "<|" may begin a special token, which is taken out before anything else
        parts = pc.extract_regex(runs, self.parted.replace("^(", "^(?P<core>").replace(")(", ")(?P<signs>"))
        odd = pc.or_(pc.is_null(parts), pc.match_substring(runs, "<|"))
        plain = pc.invert(odd)
        core = pc.utf8_lower(pc.struct_field(parts, "core").filter(plain)).dictionary_encode()
        signs = pc.struct_field(parts, "signs").filter(plain).dictionary_encode()
        words = core.dictionary.to_pylist()
        if "" in words:  # a run of signs
            words[words.index("")] = "a"
            blank = core.dictionary.index("").as_py()
        else:
            blank = -1
        word_ids, word_n = self._words(words)
        sign_ids, sign_n = self._whole(signs.dictionary.to_pylist())
        odd_ids, odd_n = self._whole(runs.filter(odd).to_pylist())
        pool = np.concatenate([word_ids, sign_ids, odd_ids])
        starts = [np.cumsum(n) - n + base for n, base in ((word_n, 0), (sign_n, len(word_ids)), (odd_n, len(word_ids) + len(sign_ids)))]
        word_n = np.where(np.arange(len(word_n)) == blank, 0, word_n)
        at, tail = core.indices.to_numpy(), signs.indices.to_numpy()
        is_odd = odd.to_numpy(zero_copy_only=False)
        first, n_first, second, n_second = (np.zeros(len(runs), dtype=np.int64) for _ in range(4))
        first[~is_odd], n_first[~is_odd] = starts[0][at], word_n[at]
        second[~is_odd], n_second[~is_odd] = starts[1][tail], sign_n[tail]
        first[is_odd], n_first[is_odd] = starts[2], odd_n
        both = gathered(pool, np.stack([first, second], axis=1).ravel(), np.stack([n_first, n_second], axis=1).ravel())
        n = n_first + n_second
        return both, np.cumsum(n) - n, n

    def encode(self, texts, end: int | None = None):
        """Ids of an array of texts (null: empty) one after another, ``end`` behind each, and how many each text has."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        runs = split.flatten().dictionary_encode()
        pool, start, n = self._of_runs(runs.dictionary)
        at, many = runs.indices.to_numpy(), pc.list_value_length(split).to_numpy()
        if end is not None:  # one more run a text
            pool, start, n = np.append(pool, np.uint32(end)), np.append(start, len(pool)), np.append(n, 1)
            at = np.insert(at, np.cumsum(many), len(n) - 1)
            many = many + 1
        whole = np.concatenate(([0], np.cumsum(n[at])))
        edges = np.concatenate(([0], np.cumsum(many)))
        return gathered(pool, start[at], n[at]), np.diff(whole[edges])


def gathered(pool, starts, sizes):
    """``pool[start : start + size]`` of all ranges, one after another."""
    import numpy as np

    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def token_pieces(docs: DataFrame, key: str, text: str, vocabulary: str, end: int = END, context: int = CONTEXT) -> DataFrame:
    """``key``, piece, start, length and ids (little-endian unsigned 32-bit) of each document's pieces.

    A document is the ids of its text (null: empty) and ``end``. Only a document of over ``context`` ids is cut,
    into pieces of ``context``, the last shorter. ``vocabulary`` is a path that workers can open. Null keys are kept, empty
    tables give no pieces, repeated rows give theirs again; other columns of ``docs`` are left out. A key called like
    a new column keeps its name, the new column gets an underscore behind its own.
    """
    kind = docs.schema[key].dataType.simpleString()
    made_names = [unlike(n, [key]) for n in ("piece", "start", "length", "ids")]

    def slices(texts):
        """Ranges of rows with about SLICE bytes of text, one row at least."""
        import numpy as np
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // SLICE
        edges = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(size)]
        return zip(edges, edges[1:], strict=False)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        tokens = TextIds(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in slices(batch.column(1)):
                ids, sizes = tokens.encode(batch.column(1).slice(a, b - a), end)
                many = -(-sizes // context)  # one at least: the end
                doc = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * context
                length = np.minimum(context, sizes[doc] - start)
                edges = np.concatenate(([0], np.cumsum(length)))
                for x in range(0, len(doc), 4096):  # some MB of ids at a time
                    part, inner = slice(x, x + 4096), edges[x : x + 4097] - edges[x]
                    data = ids[edges[x] : edges[x] + inner[-1]].astype("<u4").tobytes()
                    blobs = pa.Array.from_buffers(pa.binary(), len(inner) - 1, [None, pa.py_buffer((4 * inner).astype(np.int32).tobytes()), pa.py_buffer(data)])
                    columns = [batch.column(0).take(pa.array(doc[part] + a)), pa.array(piece[part].astype(np.int32)), pa.array(start[part]), pa.array(length[part]), blobs]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *made_names])

    kinds = ("int", "long", "long", "binary")
    return docs.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` {k}" for n, k in zip(made_names, kinds, strict=True))]))


# --- packing


class Capacities:
    """Segment tree over remaining capacities 0..top: the tightest open one that holds a length, in logarithmic time."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.leaves + capacity
        while i and self.some[i] != is_open:
            self.some[i] = is_open
            i //= 2
            is_open = self.some[2 * i] or self.some[2 * i + 1] if i else is_open

    def tightest(self, length: int) -> int | None:
        """Least open capacity of at least ``length``."""
        i = self.leaves + length
        if i >= 2 * self.leaves:
            return None
        while not self.some[i]:
            while i & 1:  # a right child: the next subtree to the right hangs off an ancestor
                i //= 2
            if not i:
                return None
            i += 1
            if not i & (i - 1):  # ran past the right end of a level
                return None
        while i < self.leaves:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], context: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: runs (length, first rank, pieces a bin, first bin, offset).

    Lengths go down; each piece enters the tightest open bin. Equal pieces are placed together: the tightest
    capacity r >= L takes floor(r / L) of them in one bin before any other bin gets tighter, so bins of one
    capacity are filled as a run. This gives the bins that placing one by one gives, while work and memory depend
    on ``context``, not on the number of pieces.
    """
    tree, bins, runs, opened = Capacities(context), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                each = context // length
                many = -(-left // each) if left < each else left // each
                bins.setdefault(context, []).append((opened, many))
                opened += many
                tree.set(context, True)
                r = context
            first, many = bins[r].pop()
            each = r // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, each, first, context - r))
                rank, left = rank + full * each, left - full * each
                if rest := r - each * length:
                    bins.setdefault(rest, []).append((first, full))
                    tree.set(rest, True)
            first, many = first + full, many - full
            if many and left:  # fewer than fill one bin
                runs.append((length, rank, left, first, context - r))
                if rest := r - left * length:
                    bins.setdefault(rest, []).append((first, 1))
                    tree.set(rest, True)
                rank, left = rank + left, 0
                first, many = first + 1, many - 1
            if many:
                bins.setdefault(r, []).append((first, many))
            if not bins.get(r):
                bins.pop(r, None)
                tree.set(r, False)
    return runs


def pack(pieces: DataFrame, length: str = "length", order: list[str] | None = None, context: int = CONTEXT) -> DataFrame:
    """``pieces`` with sequence_id and offset, best fit decreasing into sequences of ``context``.

    ``pieces`` is checkpointed and holds lengths 1..context (others, null too, raise). The driver sees the histogram of lengths
    and the plan, both bounded by ``context``; pieces learn their place from their rank among equal lengths. ``order``
    (all other columns if not given) fixes the ranks; rows equal in it may swap places. Repeated rows are placed each, empty
    tables give empty results, columns called sequence_id or offset are replaced.
    """
    import numpy as np

    counts = {r[0]: r[1] for r in pieces.groupBy(F.col(quoted(length)).cast("int")).count().collect()}
    if any(n is None or not 1 <= n <= context for n in counts):
        raise ValueError(f"lengths must be 1 to {context}")
    runs = sorted(best_fit_plan(counts, context))
    plan = np.array(runs, dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(((plan[:, 0] << 48) | plan[:, 1], plan))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rank = unlike("rank", [*pieces.columns, "sequence_id", "offset"])
    ranked = with_positions(pieces, [length], order or [c for c in pieces.columns if c != length], rank)
    schema = ", ".join([*(f"{quoted(c)} {pieces.schema[c].dataType.simpleString()}" for c in kept), "sequence_id long", "offset long"])

    def place(batches):
        import numpy as np
        import pyarrow as pa

        starts, plan = shared.value
        for batch in batches:
            size, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (length, rank))
            run = plan[np.searchsorted(starts, (size.astype(np.int64) << 48) | at, side="right") - 1]
            nth, each = at - run[:, 1], run[:, 2]
            made = [pa.array(run[:, 3] + nth // each), pa.array(run[:, 4] + (nth % each) * size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=[*kept, "sequence_id", "offset"])

    return ranked.select(*map(quoted, kept), quoted(rank)).mapInArrow(place, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packs(spark, sf_dir):
    """All documents, tokenised and packed into sequences of 4096."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_pieces(docs, "doc_id", "text", vocabulary_path())
    slim = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(slim, order=["doc_id", "piece", "ids_crc32"])


QUERIES = {"op6_best_fit_packs": op6_best_fit_packs}
ORACLES: dict[str, str] = {}
