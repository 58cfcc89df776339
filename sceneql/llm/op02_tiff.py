"""TIFF as media columns: write bytes as images, walk a file's image directories and decode every page.

Read: both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, horizontal and floating-point
predictors, 1 to 64 bits a sample, chunky and planar samples, chained directories. Write: 8-bit grey pages with any of the
compressions, in strips or tiles, with or without the horizontal predictor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneql.llm.common import prepared, table

NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
#: Fixed values of the format: tags, and the struct codes and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
#: A page holds so many rows of 64 samples at most; longer payloads take more pages.
ROW, PAGE_ROWS, STRIP_ROWS = 64, 16384, 4096
#: Bytes that one page may decode to; a file that claims more is an error, found before anything is allocated.
MOST_BYTES = 1 << 30


class BadTiff(ValueError):
    pass


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    photometric: int
    tiled: bool
    data: np.ndarray  # (height, width, samples)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, what lies between as literals of up to 128 bytes."""
    out = bytearray()
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edge, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    literal = 0

    def flush(a: int, z: int) -> None:
        for i in range(a, z, 128):
            j = min(i + 128, z)
            out.append(j - i - 1)
            out.extend(data[i:j])

    length = np.diff(starts)
    for k in np.flatnonzero(length >= 3):
        a, n = int(starts[k]), int(length[k])
        flush(literal, a)
        while n >= 2:
            m = min(n, 128)
            out += bytes((257 - m, data[a]))
            a, n = a + m, n - m
        literal = a
    flush(literal, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            if i + 1 >= len(data):
                raise BadTiff("PackBits data ends in a run")
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that widen one code early."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table_: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    width, following, prefix = 9, 258, b""
    put(256, 9)
    for k in range(len(data)):
        c = data[k : k + 1]
        if prefix + c in table_:
            prefix += c
            continue
        put(table_[prefix], width)
        table_[prefix + c] = following
        following += 1
        prefix = c
        if following == 4094:
            put(table_[prefix], width)
            put(256, width)
            table_ = {bytes((i,)): i for i in range(256)}
            width, following, prefix = 9, 258, b""
        elif following >= 1 << width:
            width += 1
    if prefix:
        put(table_[prefix], width)
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    entries, width, last = list(base), 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            entries, width, last = list(base), 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if code < len(entries):
            word = entries[code]
        elif last and code == len(entries):
            word = last + last[:1]
        else:
            raise BadTiff("LZW code out of order")
        out += word
        if last:
            entries.append(last + word[:1])
        last = word
        if len(entries) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def compress(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, ADOBE_DEFLATE):
        return zlib.compress(data, 1)
    raise BadTiff(f"compression {compression}")


def decompress(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, ADOBE_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from None
    else:
        raise BadTiff(f"compression {compression}")
    if len(out) < size:
        raise BadTiff(f"{len(out)} of {size} bytes")
    return out[:size]


def _fields(raw: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    try:
        (n,) = struct.unpack_from(f"{order}H", raw, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * k)
            code = TYPES.get(kind)
            if code is None:
                continue
            size = struct.calcsize(code) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", raw, at + 10 + 12 * k)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        (following,) = struct.unpack_from(f"{order}I", raw, at + 2 + 12 * n)
    except struct.error as e:
        raise BadTiff(str(e)) from None
    return fields, following


def _unpredicted(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: (rows, width, samples) as stored."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, width, samples = block.shape
        size = block.dtype.itemsize
        line = np.ascontiguousarray(block).view(np.uint8).reshape(rows, size, width * samples)
        flat = np.cumsum(line.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        wide = np.ascontiguousarray(flat.transpose(0, 2, 1))
        return wide.view(f">f{size}").reshape(rows, width, samples).astype(block.dtype)
    raise BadTiff(f"predictor {predictor}")


def _samples(data: bytes, rows: int, width: int, samples: int, bits: int, kind: int, order: str) -> np.ndarray:
    if bits in (1, 2, 4):
        x = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1)
        x = x[:, : x.shape[1] // bits * bits].reshape(rows, -1, bits)
        return (x * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * samples].reshape(rows, width, samples)
    code = {1: "u", 2: "i", 3: "f"}.get(kind)
    if code is None or bits not in (8, 16, 32, 64):
        raise BadTiff(f"{bits} bits of sample format {kind}")
    return np.frombuffer(data, np.dtype(f"{order}{code}{bits // 8}")).reshape(rows, width, samples)


def pages(raw: bytes, most: int = MOST_BYTES) -> Iterator[Page]:
    """The pages of a TIFF file, in the order of its directories. BadTiff where the file can't be read or a page takes more than `most` bytes."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise BadTiff("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("directories form a circle")
        seen.add(at)
        f, at = _fields(raw, at, order)
        one = lambda tag, default=None, f=f: f[tag][0] if tag in f else default
        width, height = one(WIDTH), one(HEIGHT)
        if not width or not height:
            raise BadTiff("no size")
        samples, bits, kind = one(SAMPLES, 1), one(BITS, 1), one(SAMPLE_FORMAT, 1)
        compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        tiled = TILE_OFFSETS in f
        if tiled:
            tw, th, where, counts = one(TILE_WIDTH), one(TILE_HEIGHT), f[TILE_OFFSETS], f.get(TILE_COUNTS)
        else:
            tw, th, where, counts = width, min(one(ROWS_PER_STRIP, height), height), f.get(STRIP_OFFSETS), f.get(STRIP_COUNTS)
        if not where or not tw or not th or not counts or len(counts) != len(where):
            raise BadTiff("no strips or tiles")
        planes, inner = (samples, 1) if planar == 2 else (1, samples)
        across, down = -(-width // tw), -(-height // th)
        if len(where) < planes * across * down:
            raise BadTiff("strips or tiles are missing")
        code = {1: "u", 2: "i", 3: "f"}.get(kind)
        if bits not in (1, 2, 4) and (code is None or bits not in (8, 16, 32, 64) or (code == "f" and bits == 8)):
            raise BadTiff(f"{bits} bits of sample format {kind}")
        dtype = np.dtype(np.uint8) if bits < 8 else np.dtype(f"{order}{code}{bits // 8}")
        if max(height * width, th * tw * across * down) * samples * dtype.itemsize > most:
            raise BadTiff(f"a page of more than {most} bytes")
        out = np.empty((height, width, samples), dtype=dtype)
        for k in range(planes * across * down):
            plane, y, x = k // (across * down), k // across % down * th, k % across * tw
            rows = th if tiled else min(th, height - y)
            size = rows * -(-tw * inner * bits // 8)
            if where[k] + counts[k] > len(raw):
                raise BadTiff("data beyond the file's end")
            data = decompress(raw[where[k] : where[k] + counts[k]], compression, size)
            block = _unpredicted(_samples(data, rows, tw, inner, bits, kind, order), predictor, order)
            h, w = min(rows, height - y), min(tw, width - x)
            out[y : y + h, x : x + w, plane : plane + inner] = block[:h, :w]
        yield Page(len(seen) - 1, width, height, samples, bits, kind, compression, predictor, one(PHOTOMETRIC, 1), tiled, out)


def write(images: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """8-bit grey pages (2-D uint8 arrays) as a TIFF file; tile: (height, width) of tiles instead of strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        th, tw = tile or (min(strip_rows, height), width)
        where, counts = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile and block.shape != (th, tw):
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                data = compress(np.ascontiguousarray(block).tobytes(), compression)
                where.append(len(out))
                counts.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        fields: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, where), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, where), (ROWS_PER_STRIP, 4, [th]), (STRIP_COUNTS, 4, counts)]
        values = {}
        for tag, kind, v in fields:
            data = struct.pack(f"{order}{len(v)}{TYPES[kind]}", *v)
            if len(data) > 4:
                data, at = struct.pack(f"{order}I", len(out)), data
                out += at
            values[tag] = data.ljust(4, b"\0")
        here = len(out)
        struct.pack_into(f"{order}I", out, link, here)
        out += struct.pack(f"{order}H", len(fields))
        for tag, kind, v in sorted(fields):
            out += struct.pack(f"{order}HHI", tag, kind, len(v)) + values[tag]
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def text_images(payload: bytes) -> list[np.ndarray]:
    """A payload of a multiple of 64 bytes as pages of 64 samples a row."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return [x[i : i + PAGE_ROWS] for i in range(0, len(x), PAGE_ROWS)]


def feature(decoded: list[np.ndarray]) -> str:
    """Mean and spread of the samples of each sixteenth of the rows, over all pages, as hex: 64 digits."""
    x = np.concatenate([p.reshape(p.shape[0], -1) for p in decoded])
    edge = np.linspace(0, len(x), 17).astype(int)
    out = []
    for a, z in zip(edge[:-1], edge[1:]):
        part = x[a:z] if z > a else x[min(a, len(x) - 1) : min(a, len(x) - 1) + 1]
        out.append(f"{int(part.mean(dtype=np.float64)):02x}{min(255, int(part.std(dtype=np.float64))):02x}")
    return "".join(out)


def decode_pages(media: DataFrame, id_col: str, media_col: str, most: int = MOST_BYTES) -> DataFrame:
    """(id, page, width, height, samples, bits, compression, predictor, tiled, pixels, error): a row for each page.

    A null, empty or broken file, whatever is wrong with it, gives one row with page null and the error; pages before the
    break stay. So does a page of more than `most` bytes: raise it, with the executors' memory, to read such files. Repeated
    rows give repeated pages. Other columns are ignored.
    """
    prepared(media.sparkSession)
    d = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = d.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows: list[dict] = []
                try:
                    for p in pages(b.column(1)[i].as_py() or b"", most):
                        rows.append({"page": p.page, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "pixels": p.data.tobytes(), "error": None})
                except (BadTiff, ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    rows.append({"error": str(e) or type(e).__name__})
                schema = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
                out = pa.RecordBatch.from_pylist(rows, schema=schema)
                ids = b.column(0).slice(i, 1).take(pa.array([0] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *out.columns], names=["id", *schema.names])

    return d.mapInArrow(read, f"id {kind}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string")


def layout(payload: bytes) -> dict:
    """How a payload is stored, by its own hash, so that equal texts have equal files and all codecs are in use: of 32, one
    with LZW, five with PackBits, eight in deflated tiles, eighteen in deflated strips; half of all with the predictor."""
    x = zlib.crc32(payload)
    kind, predictor = x % 32, 1 + (x >> 8) % 2
    if kind < 1:
        return {"compression": LZW, "predictor": predictor}
    if kind < 6:
        return {"compression": PACKBITS, "predictor": predictor}
    if kind < 14:
        return {"compression": ADOBE_DEFLATE, "predictor": predictor, "tile": (256, 32)}
    return {"compression": ADOBE_DEFLATE, "predictor": predictor}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[] for _ in range(7)]
        for text in b.column(1):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            payload = raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))
            media = write(text_images(payload), **layout(payload))
            decoded = [p.data for p in pages(media)]
            back = b"".join(p.tobytes() for p in decoded)
            for column, x in zip(rows, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(decoded))):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a TIFF file, read back page by page, and digested. Null texts are empty; an empty one is 64 zeros.

    Every row gives a row, repeated rows and null ids, too. Other columns are ignored.
    """
    prepared(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(prepared(spark), sf_dir, "documents"))
