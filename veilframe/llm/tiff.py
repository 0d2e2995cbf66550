"""TIFF media columns: read every page of a file, write lossless pages, compute features.

``read_pages`` walks the chain of image directories, in either byte order, and
decodes strips or tiles of 8-bit samples: plain, PackBits, LZW or deflate, with
the horizontal predictor undone.  A directory that is reached twice ends the
walk with an error, as do damaged data.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches

# Fixed values of the format: tags, compressions, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD_BYTES = {1: 1, 3: 2, 4: 4}
#: Bytes that no compression here makes of one, with room to spare.
MOST = 4096
#: How op7 stores a text: by the checksum of its payload, so all codecs, strips and tiles are in use.
LAYOUTS = [(DEFLATE, 2, False), (DEFLATE, 1, True), (PACKBITS, 1, False), (NONE, 1, True), (DEFLATE, 2, True), (LZW, 1, False), (NONE, 2, False), (DEFLATE, 1, False)]


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one entry early."""
    out, known, width, last = [], [], 9, b""
    acc = have = 0
    for byte in data:
        acc, have = (acc << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have & ((1 << width) - 1)
        if code == 256:
            known, width, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not known or code > len(known) or code == len(known) and not last:
            raise ValueError("damaged LZW data")
        now = known[code] if code < len(known) else last + last[:1]
        out.append(now)
        if last:
            known.append(last + now[:1])
            width = min(12, max(9, (len(known) + 1).bit_length()))
        last = now
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    bits, have, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    known, width, now = {bytes([b]): b for b in range(256)}, 9, b""
    size = 258
    put(256, 9)
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in known:
            now = more
            continue
        put(known[now], width)
        known[more] = size
        size += 1
        width = max(9, size.bit_length())
        if size >= 4094:
            put(256, width)
            known, width, size = {bytes([b]): b for b in range(256)}, 9, 258
        now = data[k : k + 1]
    if now:
        put(known[now], width)
        size += 1
        width = max(9, min(12, size.bit_length()))
    put(257, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


UNPACK = {NONE: lambda d: d, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
PACK = {NONE: lambda d: d, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if (size := FIELD_BYTES.get(kind)) is None:
            continue
        where = at + 10 + 12 * k
        if size * count > 4:
            (where,) = struct.unpack_from(f"{order}I", data, where)
        tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where)
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, following


def read_pages(data: bytes) -> Iterator[tuple[np.ndarray, dict]]:
    """(height x width x samples uint8, {compression, predictor, tiled}) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2) != (42,):
        raise ValueError("no TIFF")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, default=None, t=tags: t.get(tag, (default,))[0]
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or one(COMPRESSION, 1) not in UNPACK:
            raise ValueError("only chunky 8-bit samples of known compressions are read")
        tiled = TILE_OFFSETS in tags
        high = one(TILE_HEIGHT, 0) if tiled else min(one(ROWS_PER_STRIP, height), height)
        wide = one(TILE_WIDTH, 0) if tiled else width
        if min(width, height, samples, high, wide) < 1 or width * height * samples > MOST * len(data):
            raise ValueError("impossible sizes")
        across, down = -(-width // wide), -(-height // high)
        at_, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
        if not len(at_) == len(sizes) == across * down:
            raise ValueError("strips or tiles are missing")
        page = np.zeros((height, width, samples), np.uint8)
        for k, (where, n) in enumerate(zip(at_, sizes)):
            top, left = k // across * high, k % across * wide
            rows = high if tiled else min(high, height - top)
            plain = UNPACK[one(COMPRESSION, 1)](data[where : where + n])
            if len(plain) < rows * wide * samples:
                raise ValueError("a strip or tile is cut off")
            block = np.frombuffer(plain, np.uint8, rows * wide * samples).reshape(rows, wide, samples)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            page[top : top + rows, left : left + wide] = block[: height - top, : width - left]
        yield page, {"compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1), "tiled": tiled}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, block: int = 256, tiled: bool = False, order: str = "<") -> bytes:
    """Pages of height x width x samples; strips of ``block`` rows, or square tiles of ``block``."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        pieces = []
        for top in range(0, height, block):
            for left in range(0, width, block if tiled else width):
                part = page[top : top + block, left : left + (block if tiled else width)]
                if tiled:
                    part = np.pad(part, ((0, block - part.shape[0]), (0, block - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                pieces.append(PACK[compression](part.tobytes()))
        where = []
        for p in pieces:
            where.append(len(out))
            out += p
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        sizes = [len(p) for p in pieces]
        tags |= {TILE_WIDTH: [block], TILE_HEIGHT: [block], TILE_OFFSETS: where, TILE_BYTES: sizes} if tiled else {ROWS_PER_STRIP: [block], STRIP_OFFSETS: where, STRIP_BYTES: sizes}
        out += b"\0" * (len(out) % 2)
        far = {}
        for tag, values in tags.items():
            if len(values) > 1:
                far[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags))
        for tag in sorted(tags):
            out += struct.pack(f"{order}HHII", tag, 4, len(tags[tag]), far.get(tag, tags[tag][0]))
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def explode_pages(media: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """One row per page: id, page, width, height, samples, compression, predictor, tiled, pixels, error.

    Null or unreadable data give one row with page null and the error's text; a file without pages gives no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, data in zip(f["id"], f["data"]):
                rows = []
                try:
                    if data is None:
                        raise ValueError("no data")
                    for k, (page, how) in enumerate(read_pages(bytes(data))):
                        rows.append((key, k, page.shape[1], page.shape[0], page.shape[2], how["compression"], how["predictor"], how["tiled"], page.tobytes(), None))
                except (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error, zlib.error) as e:
                    rows.append((key, None, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]).astype(
                        {c: "Int64" for c in ("page", "width", "height", "samples", "compression", "predictor")} | {"tiled": "boolean"}
                    )

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"
    return media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInPandas(run, schema)


def features(pages: list[np.ndarray]) -> str:
    """Pages, size, mean of each channel and an average hash: one bit for each of 8 x 8 fields brighter than the mean."""
    flat = np.concatenate([p.reshape(-1, p.shape[2]) for p in pages])
    mean = flat.mean(axis=0)
    fields = np.array([x.mean() for x in np.array_split(flat.reshape(-1), 64)])
    bits = int("".join("01"[int(x)] for x in fields > fields.mean()), 2)
    return f"pages={len(pages)};size={pages[0].shape[1]}x{sum(p.shape[0] for p in pages)};mean={','.join(f'{m:.3f}' for m in mean)};hash={bits:016x}"


def as_media(docs: DataFrame, width: int = 64, rows_per_page: int = 2048) -> DataFrame:
    """op7: each whole text as an RGB TIFF of ``width`` pixels a row in one of LAYOUTS, read back and described.

    The payload is the text's UTF-8 (null: empty) and spaces up to a positive multiple of 3 x width bytes; long
    payloads take several pages.  Equal texts give equal values; repeated rows stay; other columns are not read.
    """
    row = 3 * width

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def one(f: dict[str, list]) -> Iterator[dict[str, list]]:
        out = []
        for text in f["text"]:
            raw = (text or "").encode("utf-8", "surrogatepass")
            padded = raw.ljust(max(row, -(-len(raw) // row) * row))
            payload = np.frombuffer(padded, np.uint8).reshape(-1, width, 3)
            compression, predictor, tiled = LAYOUTS[zlib.crc32(padded) % len(LAYOUTS)]
            media = write_tiff([payload[i : i + rows_per_page] for i in range(0, len(payload), rows_per_page)], compression, predictor, 64 if tiled else 256, tiled)
            pages = [p for p, _ in read_pages(media)]
            back = b"".join(p.tobytes() for p in pages)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)))
        yield {"doc_id": f["doc_id"], **dict(zip(names, map(list, zip(*out))))}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda: one, schema)
