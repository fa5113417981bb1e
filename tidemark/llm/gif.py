"""GIF columns: bytes stored as frames of an animation, and any GIF read back as timed frames with colour histograms.

`store` writes grey GIF89a files (palette entry i is the grey i): rows of WIDTH samples, ROWS rows a frame, LZW codes.
`read_frames` takes any GIF: it decodes the LZW code streams, applies local and global palettes, interlacing,
transparency and disposal, and returns what is to be seen after each frame, when, and its colour histogram.

Defined results: null bytes are as empty ones; `store` pads with zeros up to a positive multiple of 64; a file that is
no GIF, or breaks off before its first frame, has null frames; so has one that claims a canvas or a frame of more than
MOST_AREA samples, or whose frames would take more than MOST_BYTES together (a few bytes can claim gigabytes); samples
that are missing from a frame are not drawn; repeated rows get equal results; kept columns pass through and must not be
named like an output.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _spark, _text

#: Samples in a row, rows in a frame, hundredths of a second that each frame is shown.
WIDTH, ROWS, DELAY = 64, 1024, 10
#: Bins of each colour channel.
BINS = 4
#: Samples of a canvas or a frame, and bytes of all frames of a file, at most.
MOST_AREA, MOST_BYTES = 1 << 24, 1 << 30
FRAMES = "array<struct<frame:int,start_ms:bigint,delay_ms:int,left:int,top:int,width:int,height:int,canvas_width:int,canvas_height:int,disposal:int,pixels:binary,histogram:array<int>>>"


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits for 8-bit samples; the table begins anew whenever it is full."""
    codes, starts = [256], [0]
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    free, word = 258, -1
    for b in data:
        if word < 0:
            word = b
            continue
        key = word << 8 | b
        known = get(key)
        if known is not None:
            word = known
            continue
        put(word)
        table[key] = free
        free += 1
        word = b
        if free == 4096:
            put(256)
            starts.append(len(codes) - 1)
            table.clear()
            free = 258
    if word >= 0:
        put(word)
    put(257)
    code = np.array(codes, np.uint32)
    bounds = np.array([*starts, len(codes) - 1])
    since = np.arange(len(codes)) - np.repeat(bounds, np.diff([*bounds, len(codes)]))  # codes since the last reset, 1 for the first
    width = _widths(int(since.max()) + 1)[np.maximum(since - 1, 0)]
    width[bounds[1:-1]] = 12
    width[0] = 9
    if len(codes) - 1 not in starts:
        run = len(codes) - 2 - starts[-1]
        width[-1] = _widths(run + 1)[run]
    at = np.cumsum(width) - width
    out = np.zeros((int(at[-1] + width[-1]) + 7) // 8 + 3, np.uint8)
    shifted = code << (at & 7).astype(np.uint32)
    for k in range(3):
        np.bitwise_or.at(out, (at >> 3) + k, ((shifted >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8))
    return out[: (int(at[-1] + width[-1]) + 7) // 8].tobytes()


def _widths(n: int, least: int = 8) -> np.ndarray:
    """Bits of each of the first n codes after a reset."""
    added = (1 << least) + 1 + np.arange(n)
    added[0] = 1 << least
    return np.minimum(np.floor(np.log2(added)).astype(np.int64) + 1, 12)


def lzw_decode(data: bytes, least: int, limit: int) -> np.ndarray:
    """Samples of a code stream, limit at most. A code repeats what stood at an earlier code and one sample more, so samples are found by doubling references."""
    clear = 1 << least
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) if len(raw) > 3 else raw[:0]
    bits, at, out, total = len(data) * 8, 0, [], 0
    known = np.concatenate([[0], np.cumsum(_widths(4096, least))])
    while at + least < bits and total < limit:
        n = 4096
        while True:  # until a reset or the end is in sight
            place = known if n == 4096 else np.concatenate([known, known[-1] + 12 * np.arange(1, n - 4095)])
            place = place[: n + 1]
            fit = int(np.searchsorted(place, bits - at, side="right")) - 1
            fit = min(fit, n)
            p = at + place[:fit]
            width = np.diff(place[: fit + 1])
            code = (word[p >> 3] >> (p & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
            ends = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(ends) or fit < n:
                break
            n *= 2
        m = int(ends[0]) if len(ends) else fit
        stop = not len(ends) or code[m] == clear + 1
        at += int(place[m + 1]) if len(ends) else int(place[m])
        c = code[:m].astype(np.int64)
        literal = c < clear
        source = np.where(literal, np.arange(m), c - clear - 2)
        wrong = np.flatnonzero(~literal & ((source >= np.arange(m)) | (source < 0)))
        if len(wrong):
            stop, m = True, int(wrong[0])
            c, literal, source = c[:m], literal[:m], source[:m]
        if m:
            size, up = (~literal).astype(np.int64), source
            while True:
                more = size[up]
                if not more.any():
                    break
                size, up = size + more, up[up]
            size += 1
            start = np.cumsum(size) - size
            if start[-1] + size[-1] > limit - total:  # codes may stand for far more than the frame holds
                m, stop = int(np.searchsorted(start, limit - total)), True
                c, literal, source, size, start = c[:m], literal[:m], source[:m], size[:m], start[:m]
            ref = np.arange(int(start[-1] + size[-1]))
            ref += np.repeat(np.where(literal, 0, start[source] - start), size)
            while True:
                further = ref[ref]
                if (further == ref).all():
                    break
                ref = further
            first = np.zeros(len(ref), np.uint8)
            first[start[literal]] = c[literal]
            out.append(first[ref])
            total += len(ref)
        if stop:
            break
    return np.concatenate(out)[:limit] if out else np.zeros(0, np.uint8)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(i for g in range(256) for i in (g, g, g))


def encode(payload: bytes) -> bytes:
    """payload (a multiple of WIDTH bytes, not empty) as an animated grey GIF."""
    step = WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(payload), step) // WIDTH, 0xF7, 0, 0), _GREY]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0,", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def frames(data: bytes, grey: bool) -> list[dict] | None:
    """The frames of a file, each as the whole canvas that is to be seen: RGB, or luminance only with grey."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return None
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    common = None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data[at : at + size].ljust(768, b"\0"), np.uint8).reshape(-1, 3), at + size
    if wide * high > MOST_AREA:
        return None
    canvas = np.zeros((high, wide, 3), np.uint8)
    out, clock = [], 0
    most = MOST_BYTES // max(wide * high * (1 if grey else 3), 1)
    delay, disposal, hidden = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            block, end = _sub_blocks(data, at + 2)
            if kind == 0xF9 and len(block) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", block)
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else None
            at = end
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if packed & 0x80:
            size = 3 << ((packed & 7) + 1)
            palette, at = np.frombuffer(data[at : at + size].ljust(768, b"\0"), np.uint8).reshape(-1, 3), at + size
        if at >= len(data) or not 1 <= data[at] <= 8:
            break
        if w * h > MOST_AREA or len(out) >= most:
            return None
        least = data[at]
        stream, at = _sub_blocks(data, at + 1)
        index = lzw_decode(stream, least, w * h)
        drawn = np.arange(w * h) < len(index)
        index = np.concatenate([index, np.zeros(w * h - len(index), np.uint8)]).reshape(h, w)
        drawn = drawn.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            turned = np.empty(h, np.int64)
            turned[order] = np.arange(h)
            index, drawn = index[turned], drawn[turned]
        if hidden is not None:
            drawn = drawn & (index != hidden)
        before = canvas.copy() if disposal == 3 else None
        room = canvas[top : top + h, left : left + w]
        seen = (palette if palette is not None else np.zeros((256, 3), np.uint8))[index[: room.shape[0], : room.shape[1]]]
        on = drawn[: room.shape[0], : room.shape[1]]
        if on.all():
            room[:] = seen
        else:
            room[on] = seen[on]
        flat = canvas.reshape(-1, 3)
        step = 256 // BINS
        bins = flat[:, 0] // step * (BINS * BINS) + flat[:, 1] // step * BINS + flat[:, 2] // step
        pixels = flat
        if grey:
            pixels = ((flat.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000).astype(np.uint8)
        out.append({
            "frame": len(out), "start_ms": clock, "delay_ms": delay * 10, "left": left, "top": top, "width": w, "height": h, "canvas_width": wide, "canvas_height": high,
            "disposal": disposal, "pixels": pixels.tobytes(), "histogram": np.bincount(bins, minlength=BINS**3),
        })
        clock += delay * 10
        if disposal == 2:
            room[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, hidden = 0, 0, None
    return out or None


def store(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, n_bytes (of the unpadded text or binary) and media (its bytes as a GIF)."""

    def run(batches):
        for batch in batches:
            for part in _text.slices(batch, "_text"):
                data = [(x or b"") + bytes(-len(x or b"") % 64 or 64 * (not x)) for x in part.column("_text").to_pylist()]
                size = part.column("_n")
                yield pa.RecordBatch.from_arrays([*part.columns[2:], size, pa.array([encode(x) for x in data], pa.binary())], names=[*keep, "n_bytes", "media"])

    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(data.alias("_text"), F.octet_length(data).cast("long").alias("_n"), *keep).mapInArrow(run, _spark.kept(docs, keep, "n_bytes long, media binary"))


def read_frames(docs: DataFrame, keep: list[str], media_col: str = "media", grey: bool = False) -> DataFrame:
    """The columns keep and frames: what is to be seen after each frame (pixels: RGB, or luminance only), when, and its histogram of BINS**3 colours."""

    def run(batches):
        ints = ("frame", "delay_ms", "left", "top", "width", "height", "canvas_width", "canvas_height", "disposal")
        order = ("frame", "start_ms", "delay_ms", "left", "top", "width", "height", "canvas_width", "canvas_height", "disposal", "pixels", "histogram")
        for batch in batches:
            for part in _text.slices(batch, "_media"):
                rows = [frames(x.as_py(), grey) if x.is_valid else None for x in part.column("_media")]
                flat = [f for r in rows for f in r or ()]
                columns = {n: pa.array([f[n] for f in flat], pa.int32()) for n in ints}
                columns["start_ms"] = pa.array([f["start_ms"] for f in flat], pa.int64())
                columns["pixels"] = pa.array([f["pixels"] for f in flat], pa.binary())
                h = np.concatenate([f["histogram"] for f in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
                columns["histogram"] = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BINS**3), pa.array(h))
                at = np.cumsum([0, *(len(r or ()) for r in rows)]).astype(np.int32)
                starts = pa.array(at, mask=np.array([*(r is None for r in rows), False]))
                lists = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([columns[n] for n in order], list(order)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists], names=[*keep, "frames"])

    return docs.select(F.col(media_col).alias("_media"), *keep).mapInArrow(run, _spark.kept(docs, keep, f"frames {FRAMES}"))
