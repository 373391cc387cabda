"""GIF media columns: encode, decode (LZW, palettes, disposal, transparency) and colour-histogram frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquarry.llm.common import table

#: Bytes of a row of samples, and rows of a frame, in the registered query.
WIDTH, ROWS = 192, 256
#: Codes of one table, and most bits of a code, by the format.
TABLE, MOST_BITS = 4096, 12


# --- LZW


#: Schedules made so far: plain arrays, which travel to workers with the functions that use them.
_SCHEDULES: dict = {}


def _schedule(root: int):
    """Bit offset of the n-th code after a clear, and the widths: the n-th code finds root + 2 + max(0, n - 1) codes known."""
    import numpy as np

    if root not in _SCHEDULES:
        known = (1 << root) + 2 + np.maximum(np.arange(TABLE + 1) - 1, 0)
        width = np.minimum(np.maximum(np.ceil(np.log2(known + 1)), root + 1), MOST_BITS).astype(np.int64)
        _SCHEDULES[root] = np.concatenate(([0], np.cumsum(width))), width
    return _SCHEDULES[root]


def _pack(codes, widths) -> bytes:
    """Codes as a bit stream, lowest bit first."""
    import numpy as np

    codes, widths = np.asarray(codes, dtype=np.int64), np.asarray(widths, dtype=np.int64)
    bits = (codes[:, None] >> np.arange(MOST_BITS)) & 1
    return np.packbits(bits[np.arange(MOST_BITS) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_encode(data: bytes, root: int) -> bytes:
    """A GIF code stream: clear, codes, end; the table is cleared whenever it is full."""
    clear, end = 1 << root, (1 << root) + 1
    _, width = _schedule(root)
    all_codes, all_widths = [], []
    codes, table_, following = [], {}, end + 1
    most = TABLE - end - 2  # codes after a clear that fill the table

    def flush(last: bool) -> None:
        import numpy as np

        row = [clear, *codes, end] if last else [clear, *codes]
        all_codes.append(np.array(row))
        all_widths.append(np.concatenate((all_widths_of_clear(), width[: len(row) - 1])))

    previous = [root + 1]

    def all_widths_of_clear():
        import numpy as np

        # a clear code has the width that the stream has reached before it
        own = previous[0]
        previous[0] = int(width[len(codes)])
        return np.array([own])

    if not data:
        flush(True)
    else:
        prefix = data[0]
        get = table_.get
        for sample in data[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            table_[key] = following
            following += 1
            prefix = sample
            if len(codes) == most:
                flush(False)
                codes.clear()
                table_.clear()
                following = end + 1
        codes.append(prefix)
        flush(True)
    import numpy as np

    return _pack(np.concatenate(all_codes), np.concatenate(all_widths))


def lzw_decode(stream: bytes, root: int, pixels: int) -> bytes:
    """At most ``pixels`` samples of a code stream; what is missing is 0, as in broken files.

    Each code but the first after a clear defines one: the string before it and the first sample of its own. As a code's width
    depends only on its number since the last clear, all codes up to the next clear are cut out of the bits at once.
    """
    import numpy as np

    clear, end = 1 << root, (1 << root) + 1
    offsets, width = _schedule(root)
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total = 8 * len(stream)
    singles = [bytes((v,)) for v in range(clear)] + [b"", b""]
    parts, made = [], 0
    start, read, strings, before = 0, 0, singles.copy(), b""  # start of the codes since a clear, how many were read
    while made < pixels:
        n = np.arange(read, read + TABLE)
        starts = start + np.where(n < TABLE, offsets[np.minimum(n, TABLE)], offsets[TABLE] + (n - TABLE) * MOST_BITS)
        widths = np.where(n < TABLE, width[np.minimum(n, TABLE)], MOST_BITS)
        whole = int(np.searchsorted(starts + widths, total, side="right"))
        starts, widths = starts[:whole], widths[:whole]
        byte = starts >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (starts & 7)) & ((1 << widths) - 1)
        stop = np.nonzero((codes == clear) | (codes == end))[0]
        last = int(stop[0]) if len(stop) else len(codes)
        grow, emit, at = strings.append, parts.append, len(parts)
        for code in codes[:last].tolist():
            try:
                now = strings[code]
            except IndexError:
                if code > len(strings) or not before:  # no such code: a broken file
                    return b"".join(parts)[:pixels].ljust(pixels, b"\0")
                now = before + before[:1]  # the code being defined: its last sample is its first
            if before:
                grow(before + now[:1])
            emit(now)
            before = now
        made += sum(map(len, parts[at:]))
        if len(stop):
            if codes[last] == end:
                break
            start, read, strings, before = int(starts[last] + widths[last]), 0, singles.copy(), b""
        elif whole < TABLE:
            break
        else:
            read += TABLE
            del strings[TABLE:]
    return b"".join(parts)[:pixels].ljust(pixels, b"\0")


# --- files


@dataclass
class Frame:
    """One composed frame: the canvas after it was drawn, and what the file says of it."""

    number: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    rgb: object = field(repr=False)  # height x width x 3 canvas
    opaque: object = field(repr=False)  # canvas pixels that something was drawn on


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def encode_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = 4) -> bytes:
    """A grey GIF whose frames, top to bottom and in order, are ``samples`` (a multiple of ``width``).

    Lossless: the palette's entry v is the grey v. The last frame may be lower than the canvas.
    """
    if len(samples) % width or not samples:
        raise ValueError("samples must fill rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", bytes(v for g in range(256) for v in (g, g, g))]
    step = width * rows
    for a in range(0, len(samples), step):
        part = samples[a : a + step]
        out.append(b"\x21\xf9\x04\x04" + delay_cs.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08")
        out.append(_blocks(lzw_encode(part, 8)))
    out.append(b"\x3b")
    return b"".join(out)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _interlaced(height: int) -> list[int]:
    return [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]


def decode_gif(data: bytes):
    """The frames of a GIF87a or GIF89a file, composed one after another.

    Local palettes win over the global one; transparent samples leave the canvas; after a frame, disposal 2 clears its
    rectangle, 3 restores what was there before it. A file that is no GIF raises; a truncated one yields what it has.
    """
    import numpy as np

    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF file")
    short = lambda i: int.from_bytes(data[i : i + 2], "little")
    canvas_w, canvas_h, flags = short(6), short(8), data[10]
    at, shared = 13, None

    def palette(at: int, bits: int):
        n = 3 << bits
        full = np.zeros(768, dtype=np.uint8)
        got = np.frombuffer(data[at : at + n], dtype=np.uint8)
        full[: len(got)] = got
        return full.reshape(256, 3), at + n

    if flags & 0x80:
        shared, at = palette(at, (flags & 7) + 1)
    rgb, opaque = np.zeros((canvas_h, canvas_w, 3), dtype=np.uint8), np.zeros((canvas_h, canvas_w), dtype=bool)
    number, delay, disposal, clear = 0, 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, at = _sub_blocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                clear = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, flags = short(at + 1), short(at + 3), short(at + 5), short(at + 7), data[at + 9]
        at += 10
        colours = shared
        if flags & 0x80:
            colours, at = palette(at, (flags & 7) + 1)
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        root = data[at] if at < len(data) else 0
        stream, at = _sub_blocks(data, at + 1)
        if not 1 <= root <= 8:
            raise ValueError("bad code size")
        index = np.frombuffer(lzw_decode(stream, root, w * h), dtype=np.uint8).reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(index)
            straight[_interlaced(h)] = index
            index = straight
        before = (rgb.copy(), opaque.copy()) if disposal == 3 else None
        box = (slice(top, min(top + h, canvas_h)), slice(left, min(left + w, canvas_w)))
        seen = index[: max(0, box[0].stop - top), : max(0, box[1].stop - left)]
        drawn = seen != clear if clear is not None else np.ones(seen.shape, dtype=bool)
        rgb[box][drawn] = colours[seen][drawn]
        opaque[box] |= drawn
        yield Frame(number, delay, left, top, w, h, disposal, rgb.copy(), opaque.copy())
        if disposal == 2:
            rgb[box], opaque[box] = 0, False
        elif before is not None:
            rgb, opaque = before
        number, delay, disposal, clear = number + 1, 0, 0, None


def colour_histogram(frame: Frame, bins: int = 4) -> list[int]:
    """Opaque canvas pixels by ``bins``^3 cells of red, green and blue."""
    import numpy as np

    seen = frame.rgb.reshape(-1, 3) if frame.opaque.all() else frame.rgb[frame.opaque]
    cell = np.arange(256) * bins // 256
    return np.bincount(((cell * bins**2)[seen[:, 0]] + (cell * bins)[seen[:, 1]] + cell[seen[:, 2]]), minlength=bins**3).tolist()


# --- columns


def encode_column(df: DataFrame, payload: str, content: str = "content", width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """``df`` with ``payload`` (binary, a positive multiple of ``width`` long) replaced by a GIF file ``content``; null stays null.

    Repeated rows stay, an empty table stays empty; a column called ``content`` is replaced.
    """
    kept = [f for f in df.schema if f.name not in (payload, content)]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{content}` binary"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(payload))
            for a in range(0, max(1, batch.num_rows), 64):
                part = column.slice(a, 64)
                made = [encode_gif(v.as_py(), width, rows) if v.is_valid else None for v in part]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).slice(a, 64) for n in names), pa.array(made, pa.binary())], names=[*names, content])

    return df.select(*names, payload).mapInArrow(run, schema)


FRAME = "frame int, delay_ms int, left int, top int, width int, height int, disposal int, samples binary, histogram array<long>"


def frames(df: DataFrame, content: str = "content", bins: int = 4) -> DataFrame:
    """A row for each frame of each GIF: the other columns, frame number, delay, box, disposal, the box's canvas as RGB bytes, histogram.

    Null content has no frames; content that is no GIF raises. Columns called like the new ones are replaced.
    """
    new = [x.split()[0] for x in FRAME.split(", ")]
    kept = [f for f in df.schema if f.name != content and f.name not in new]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), FRAME])

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32()] * 7 + [pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(content))
            for i in range(batch.num_rows):
                if not column[i].is_valid:
                    continue
                rows = []
                for f in decode_gif(column[i].as_py()):
                    box = f.rgb[f.top : f.top + f.height, f.left : f.left + f.width]
                    rows.append((f.number, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, box.tobytes(), colour_histogram(f, bins)))
                same = [batch.column(batch.schema.get_field_index(n)).take(pa.array([i] * len(rows), pa.int64())) for n in names]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([r[k] for r in rows], kinds[k]) for k in range(9))], names=[*names, *new])

    return df.select(*names, content).mapInArrow(run, schema)


def digests(df: DataFrame, content: str = "content", bins: int = 4) -> DataFrame:
    """``df`` with what a decoder sees of each grey GIF: payload (all frames' samples in order), n_frames, duration_ms, histogram.

    The payload is read back from the composed frames. Null content gives nulls, content that is no GIF raises. Repeated rows stay,
    an empty table stays empty; columns called like the new ones are replaced.
    """
    kept = [f for f in df.schema if f.name not in ("payload", "n_frames", "duration_ms", "histogram")]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "payload binary, n_frames int, duration_ms long, histogram array<long>"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(content))
            for a in range(0, max(1, batch.num_rows), 64):
                out = ([], [], [], [])
                for v in column.slice(a, 64):
                    if not v.is_valid:
                        for x in out:
                            x.append(None)
                        continue
                    parts, delay, total = [], 0, np.zeros(bins**3, dtype=np.int64)
                    for f in decode_gif(v.as_py()):
                        parts.append(f.rgb[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
                        delay += f.delay_ms
                        total += colour_histogram(f, bins)
                    for x, y in zip(out, (b"".join(parts), len(parts), delay, total.tolist()), strict=True):
                        x.append(y)
                made = [pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).slice(a, 64) for n in names), *made], names=[*names, "payload", "n_frames", "duration_ms", "histogram"])

    return df.mapInArrow(run, schema)


def op7_gif_media(spark, sf_dir):
    """All texts as grey GIFs and back; feature: frames, milliseconds and the grey diagonal of the colour histogram."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    padded = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / WIDTH)) * WIDTH
    fill = F.encode(F.repeat(F.lit(" "), (padded - F.col("n_bytes")).cast("int")), "UTF-8")
    docs = docs.select("doc_id", "n_bytes", F.concat("raw", fill).alias("payload"))
    seen = digests(encode_column(docs, "payload"))
    grey = F.array_join(F.transform(F.array(*(F.lit(i * 21) for i in range(4))), lambda i: F.get("histogram", i).cast("string")), "/")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        F.concat_ws(" ", F.col("n_frames").cast("string"), F.col("duration_ms").cast("string"), grey).alias("feature"),
    )


QUERIES = {"op7_gif_media": op7_gif_media}
ORACLES: dict[str, str] = {}
