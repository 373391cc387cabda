"""Language ID by language-bitmask n-gram filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyquarry.llm.common import cut, table

UNKNOWN = "und"
#: Most languages that may be learned; the driver holds their filters.
MAX_LANGUAGES = 4096
#: n-grams of a text that are probed at once.
CHUNK = 1 << 18


# --- n-grams


def _letters(text: str):
    """Code points of the lower-cased text with every run of non-letters made one blank, blanks at both ends.

    None if it has no letter.
    """
    import re

    import numpy as np

    low = text.lower()
    if low.isascii():
        kept = re.sub(r"[^a-z]+", " ", low)
    else:
        # \w without digits and underscores; then marks and numbers that \w still holds
        kept = re.sub(r"[\W\d_]+", " ", low)
    kept = f" {kept.strip()} "
    if not any(c.isalpha() for c in kept[:64]) and not any(c.isalpha() for c in kept):
        return None
    return np.frombuffer(kept.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(codes, orders: tuple[int, ...]):
    """64-bit hashes of the n-grams of ``orders``; those that are only blanks at the ends count like others."""
    import numpy as np

    out = []
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        out.append(h * np.uint64(0xBF58476D1CE4E5B9))
    h = np.concatenate(out) if out else np.empty(0, dtype=np.uint64)
    return h ^ (h >> np.uint64(31))


class LanguageFilter:
    """Bloom filters of all languages in one array: bit l % 64 of word l // 64 belongs to language l, a row of slots for each word.

    An n-gram sets its languages' bits in ``probes`` slots; ANDing these slots returns the mask of all languages that hold
    it. ``fp[l]`` is the chance that a strange n-gram seems to be in l.
    """

    def __init__(self, languages: list[str], slots, probes: int, orders: tuple[int, ...]):
        import numpy as np

        self.languages, self.slots, self.probes, self.orders = languages, slots, probes, orders
        fill = [np.count_nonzero(slots[l // 64] & np.uint64(1 << l % 64)) / slots.shape[1] for l in range(len(languages))]
        self.fp = np.array(fill) ** probes

    def state(self) -> dict:
        """Plain arrays: workers make the filter anew from them, so they need no package."""
        return {"languages": self.languages, "slots": self.slots, "probes": self.probes, "orders": self.orders}

    @staticmethod
    def places(h, size: int, probes: int):
        import numpy as np

        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(probes)]

    @classmethod
    def build(cls, languages, grams: list, orders, bits_per_gram: int = 12, probes: int = 4) -> LanguageFilter:
        import numpy as np

        size = max(64, bits_per_gram * max([1, *map(len, grams)])) | 1
        slots = np.zeros((max(1, -(-len(languages) // 64)), size), dtype=np.uint64)
        for number, own in enumerate(grams):
            for at in cls.places(np.asarray(own, dtype=np.uint64), size, probes):
                slots[number // 64, at] |= np.uint64(1 << number % 64)
        return cls(list(languages), slots, probes, tuple(orders))

    def masks(self, h):
        """A word of each n-gram's mask after another."""
        places = self.places(h, self.slots.shape[1], self.probes)
        for word in self.slots:
            mask = word[places[0]]
            for at in places[1:]:
                mask &= word[at]
            yield mask

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and a score of 0 to 1: the share of its n-grams among those that all languages explain.

        The counts of all languages are corrected for the filter's false positives. Ties go to the first
        language; a text without letters is ``und`` with score 0.
        """
        found = self.explained(text)
        if found is None:
            return UNKNOWN, 0.0
        true, _ = found
        best = int(true.argmax())
        whole = true.sum()
        return self.languages[best], float(true[best] / whole) if whole > 0 else 0.0

    def coverage(self, text: str | None) -> tuple[str, float]:
        """The language of ``decide`` and the share of all n-grams of the text that it explains."""
        found = self.explained(text)
        if found is None:
            return UNKNOWN, 0.0
        true, n = found
        best = int(true.argmax())
        return self.languages[best], float(true[best] / n) if n else 0.0

    def explained(self, text: str | None):
        """How many n-grams each language explains, corrected for the filter's false positives, and of how many; None without letters."""
        import numpy as np

        codes = _letters(text) if text and self.languages else None
        if codes is None:
            return None
        n, k = 0, len(self.languages)
        hits = np.zeros(k)
        for order in self.orders:
            for at in range(0, max(1, len(codes) - order + 1), CHUNK):  # long texts piece by piece, none left out
                h = _hashes(codes[at : at + CHUNK + order - 1], (order,))
                for word, found in enumerate(self.masks(h)):
                    # counts of equal masks first: few differ
                    masks, times = np.unique(found, return_counts=True)
                    own = np.arange(min(64, k - 64 * word), dtype=np.uint64)
                    hits[64 * word : 64 * word + len(own)] += (((masks[:, None] >> own[None, :]) & np.uint64(1)) * times[:, None].astype(np.uint64)).sum(axis=0)
                n += len(h)
        return np.maximum(0.0, (hits - n * self.fp) / np.maximum(1e-9, 1 - self.fp)), n


# --- learning


def fit(
    labelled: DataFrame,
    key: str,
    text: str = "text",
    lang: str = "lang",
    sample: int = 4000,
    orders: tuple[int, ...] = (2, 3, 4),
    grams: int = 20_000,
    share: float = 0.5,
) -> LanguageFilter:
    """A filter from labelled texts; rows with a null text or language are not used.

    Learns from about ``sample`` texts of each language at most (chosen by a hash of ``key``): this bound keeps
    learning cheap at any size. An n-gram enters a language's filter if its rate there is at least ``share`` of its
    highest rate in any language; the ``grams`` most frequent of these are kept for each. More than
    ``MAX_LANGUAGES`` languages raise. Without labelled texts the filter knows no language, and every text is ``und``. Repeated
    rows count as often as they come.
    """
    import numpy as np

    chosen, languages = labelled_sample(labelled, key, text, lang, sample)
    if not languages:
        return LanguageFilter([], np.zeros((1, 64), dtype=np.uint64), 1, orders)

    def count(batches):
        import pyarrow as pa

        def send(found: dict):
            for name, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            found, held = {}, 0
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = _letters(value.as_py())
                if codes is None:
                    continue
                found.setdefault(name, []).append(_hashes(codes, orders))
                held += len(orders) * len(codes)
                if held > 1 << 22:  # some MB of n-grams at a time
                    yield from send(found)
                    found, held = {}, 0
            yield from send(found)

    # n-grams that a part holds once are sent too, so counts are whole over the sample
    tallied = cut(chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")))
    totals = tallied.groupBy("lang").agg(F.sum("n").alias("whole"))  # at most MAX_LANGUAGES rows
    rated = tallied.where("n > 1").join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("whole"))
    rated = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= share * F.col("top"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = rated.withColumn("nth", nth).where(F.col("nth") <= grams).select("lang", "gram").toPandas()  # languages x grams rows at most
    own = [best.loc[best["lang"] == x, "gram"].to_numpy(dtype=np.int64).view(np.uint64) for x in languages]
    return LanguageFilter.build(languages, own, orders)


def labelled_sample(labelled: DataFrame, key: str, text: str, lang: str, sample: int) -> tuple[DataFrame, list[str]]:
    """Columns lang and text of about ``sample`` texts of each language, chosen by a hash of ``key``; and all languages, sorted."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, F.lit(11)).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    odds = labelled.sparkSession.createDataFrame([(x, sample / n) for x, n in counts.items()], "lang string, odds double")
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    return rows.join(F.broadcast(odds), "lang").where(u < F.col("odds")).select("lang", "text"), sorted(counts)  # odds: at most MAX_LANGUAGES rows


def usual_coverage(labelled: DataFrame, model: LanguageFilter, key: str, text: str = "text", lang: str = "lang", sample: int = 1000) -> dict[str, float]:
    """Share of n-grams that each language explains in its own labelled texts, about ``sample`` of each (chosen by a hash of ``key``)."""
    if not model.languages:
        return {}
    chosen, _ = labelled_sample(labelled, key, text, lang, sample)
    shared = labelled.sparkSession.sparkContext.broadcast(model.state())

    def rate(batches):
        import pyarrow as pa

        model = LanguageFilter(**shared.value)
        number = {name: i for i, name in enumerate(model.languages)}
        for batch in batches:
            names, held, whole = [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name in number and (found := model.explained(value.as_py())) is not None:
                    names.append(name)
                    held.append(float(found[0][number[name]]))
                    whole.append(float(found[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.float64()), pa.array(whole, pa.float64())], names=["lang", "held", "whole"])

    rates = chosen.mapInArrow(rate, "lang string, held double, whole double").groupBy("lang").agg(F.sum("held"), F.sum("whole")).collect()
    return {name: held / whole for name, held, whole in rates if whole}


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep_text: bool = False, usual: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with the language and score of each whole text (see ``LanguageFilter.decide``).

    With ``usual``, the score is instead the share of the text's n-grams that the language explains, over that usual for it.

    Only the text is used. Null and empty texts and those without letters are ``und`` with score 0. Columns called like
    the new ones are replaced; repeated rows stay; empty tables stay empty.
    """
    kept = [f for f in docs.schema if f.name not in (lang_pred, score) and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{lang_pred}` string", f"`{score}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # bounded by languages x grams

    def judge(model, value):
        if usual is None:
            return model.decide(value)
        name, covered = model.coverage(value)
        return name, covered / usual[name] if usual.get(name) else covered

    def run(batches):
        import pyarrow as pa

        model = LanguageFilter(**shared.value)
        for batch in batches:
            out = [judge(model, v.as_py()) if model.languages else (UNKNOWN, 0.0) for v in batch.column(batch.schema.get_field_index(text))]
            made = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *made], names=[*names, lang_pred, score])

    return docs.select(*names, *([] if text in names else [text])).mapInArrow(run, schema)


def held_out(key: str, modulus: int, remainder: int):
    """Whether crc32 of the key as text leaves ``remainder``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op8_language_filters(spark, sf_dir):
    """Every document's language, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 3, 1)).select("doc_id", "text", "lang"), "doc_id")
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_filters": op8_language_filters}
ORACLES: dict[str, str] = {}
