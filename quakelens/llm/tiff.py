"""TIFF media columns: write byte payloads as images, and read images as one row per page.

The reader walks the chain of image directories in either byte order and decodes strips and tiles without compression or
with PackBits, LZW or deflate, undoing the horizontal predictor, for 8- and 16-bit samples. The writer makes the same
variety from a payload, chosen by the payload alone, so equal payloads give equal files.

Defined results: a null text is an empty payload, which is padded to one row of 64 zeros; a null, empty or damaged image
gives, after the pages before the damage, one row with page -1 and a message in `error`, and no pixels; repeated rows give repeated pages. Pages come in file
order and a file's pages stand together in a partition. Memory is bounded by one image at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelens.llm.common import small_batches, table

WIDTH = 64
PAGE_ROWS = 512
STRIP_ROWS = 64
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773  # fixed values of the format
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}  # bytes by field type
_RUN = re.compile(rb"(?s)(.)\1{2,127}")


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    for run in [*((m.start(), m.end()) for m in _RUN.finditer(data)), (len(data), len(data))]:
        for i in range(at, run[0], 128):
            part = data[i : min(i + 128, run[0])]
            out.append(len(part) - 1)
            out += part
        if run[1] > run[0]:
            out += bytes((257 - (run[1] - run[0]), data[run[0]]))
        at = run[1]
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 + (n > 128)
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a width changes one code early, as readers of this format expect."""
    bits, width, codes = 256, 9, 258
    held, known, current = 9, {bytes((i,)): i for i in range(256)}, b""
    words = [(256, 9)]
    for i in range(len(data)):
        longer = current + data[i : i + 1]
        if longer in known:
            current = longer
            continue
        words.append((known[current], width))
        known[longer] = codes
        codes += 1
        if codes == 4094:
            words.append((256, width))
            known, codes, width = {bytes((j,)): j for j in range(256)}, 258, 9
        elif codes + 1 > 1 << width:
            width += 1
        current = data[i : i + 1]
    if current:
        words.append((known[current], width))
        codes += 1
        if codes + 1 > 1 << width and width < 12:
            width += 1
    words.append((257, width))
    out, bits, held = bytearray(), 0, 0
    for code, n in words:
        bits, held = (bits << n) | code, held + n
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1
    if held:
        out.append(bits << (8 - held))
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, entries, before = bytearray(), [], b""
    width, bits, held, at = 9, 0, 0, 0
    while len(out) < size:
        while held < width and at < len(data):
            bits, held, at = (bits << 8) | data[at], held + 8, at + 1
        if held < width:
            break
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            entries, before, width = [], b"", 9
            continue
        known = 258 + len(entries)
        if code < 256:
            entry = bytes((code,))
        elif code < known:
            entry = entries[code - 258]
        elif code == known and before:
            entry = before + before[:1]
        else:
            raise ValueError("an LZW code is out of range")
        out += entry
        if before:
            entries.append(before + entry[:1])
        before = entry
        if 258 + len(entries) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out[:size])


_PACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits}
_UNPACK: dict[int, Callable[[bytes, int], bytes]] = {
    NONE: lambda d, n: d, LZW: unlzw, DEFLATE: lambda d, n: zlib.decompress(d), OLD_DEFLATE: lambda d, n: zlib.decompress(d), PACKBITS: unpackbits,
}


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<") -> bytes:
    """A file of 8-bit grey pages, WIDTH wide and at most PAGE_ROWS high; the payload's length is a multiple of WIDTH."""
    mark = b"II" if order == "<" else b"MM"
    out = bytearray(mark + struct.pack(order + "HI", 42, 0))
    link = 4  # where the offset of the next directory belongs
    for first in range(0, len(payload), PAGE_ROWS * WIDTH):
        page = np.frombuffer(payload[first : first + PAGE_ROWS * WIDTH], np.uint8).reshape(-1, WIDTH)
        offsets, lengths = [], []
        for row in range(0, len(page), STRIP_ROWS):
            block = page[row : row + STRIP_ROWS]
            if tiled and len(block) < STRIP_ROWS:
                block = np.vstack([block, np.zeros((STRIP_ROWS - len(block), WIDTH), np.uint8)])
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            packed = _PACK[compression](block.tobytes())
            offsets.append(len(out))
            lengths.append(len(packed))
            out += packed
        out += b"\0" * (len(out) % 2)
        many = len(offsets) > 1
        lists = len(out)
        if many:
            out += struct.pack(f"{order}{2 * len(offsets)}I", *offsets, *lengths)
        where, sizes = (lists, lists + 4 * len(offsets)) if many else (offsets[0], lengths[0])
        layout = [(322, 4, 1, WIDTH), (323, 4, 1, STRIP_ROWS), (324, 4, len(offsets), where), (325, 4, len(offsets), sizes)] if tiled else [(273, 4, len(offsets), where), (278, 4, 1, STRIP_ROWS), (279, 4, len(offsets), sizes)]
        tags = sorted([(256, 4, 1, WIDTH), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor), *layout])
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, kind, n, value in tags:
            out += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """The integer fields of the directory at an offset, and the next directory's offset."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        place = at + 10 + 12 * i
        if kind in (1, 3, 4) and count:
            if _SIZES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            fields[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read(data: bytes) -> Iterator[dict]:
    """A dict for each page; ValueError, struct.error, zlib.error, IndexError or KeyError where the file is damaged."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        f, at = _fields(data, order, at)
        width, height = f[256][0], f[257][0]
        samples, depth = f.get(277, [1])[0], f.get(258, [1])[0]
        compression, predictor = f.get(259, [1])[0], f.get(317, [1])[0]
        if depth not in (8, 16) or f.get(284, [1])[0] != 1:
            raise ValueError("only 8- and 16-bit interleaved samples are read")
        kind = np.dtype(np.uint8) if depth == 8 else np.dtype(order + "u2")
        tiled = 324 in f
        across, down = (f[322][0], f[323][0]) if tiled else (width, min(height, f.get(278, [height])[0]))
        offsets, lengths = (f[324], f[325]) if tiled else (f[273], f[279])
        per_row = -(-width // across)
        # No way of packing gives more than LZW's 4096 bytes for 12 bits, so a directory that claims more is damaged.
        if len(offsets) != per_row * -(-height // down) or height * width * samples * kind.itemsize > 4096 * len(data):
            raise ValueError("the directory doesn't fit the image data")
        page = np.zeros((height, width, samples), kind)
        for i, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
            top, left = i // per_row * down, i % per_row * across
            rows = down if tiled else min(down, height - top)
            raw = _UNPACK[compression](data[offset : offset + length], rows * across * samples * kind.itemsize)
            block = np.frombuffer(raw, kind).reshape(rows, across, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            part = page[top : top + rows, left : left + across]
            part[:] = block[: part.shape[0], : part.shape[1]]
        yield {"width": width, "height": height, "samples": samples, "depth": depth, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": page.tobytes()}


def choose(payload: bytes) -> dict:
    """How a payload is stored: mostly deflate, and some of everything that the format offers."""
    r = zlib.crc32(payload) % 32
    if r == 0:
        return {"compression": LZW, "predictor": 2}
    if r < 4:
        return {"compression": PACKBITS}
    return {"compression": DEFLATE, "predictor": 1 + (r % 3 == 0), "tiled": r < 16, "order": ">" if r % 2 else "<"}


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PAGES = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("depth", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
PAGE_COLUMNS = "page int, width int, height int, samples int, depth int, compression int, predictor int, tiled boolean, pixels binary, error string"
_PAGE_BATCH = 64


def store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        media = [write(p, **choose(p)) for p in map(payload_of, texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array(media, pa.binary())], schema=_STORED)


def page_batches(batches: Iterator[pa.RecordBatch], media: str = "media") -> Iterator[pa.RecordBatch]:
    """Rows of the other columns with a row for each page of the media column."""
    for batch in batches:
        place = batch.schema.get_field_index(media)
        others = [f for i, f in enumerate(batch.schema) if i != place]
        schema = pa.schema([*others, *_PAGES])
        rows: list[dict] = []
        for row in batch.to_pylist():
            data = row.pop(media)
            try:
                for page, got in enumerate(read(data or b"")):
                    rows.append(row | got | {"page": page, "error": None})
                    if len(rows) >= _PAGE_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            except (ValueError, struct.error, zlib.error, IndexError, KeyError) as e:
                rows.append(row | {"page": -1, "error": f"{type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(rows, schema)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each document's text as a TIFF file."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store_batches, "doc_id long, n_bytes long, media binary")


def pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of the files in a binary column; the other columns are kept (none may be named like a page's)."""
    others = ", ".join(f"`{n}` {t}" for n, t in files.dtypes if n != media)
    return files.mapInArrow(lambda it: page_batches(it, media), f"{others}, {PAGE_COLUMNS}")


def _feature(data: bytes, count: int) -> str:
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    levels = np.arange(256)
    mean = float((shares * levels).sum())
    spread = float(np.sqrt((shares * (levels - mean) ** 2).sum()))
    some = shares[shares > 0]
    return f"pages={count};mean={mean:.6f};std={spread:.6f};entropy={float(-(some * np.log2(some)).sum()):.6f}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        yield batch.append_column("media_bytes", pa.array([len(m) for m in media], pa.int64())).append_column("media_sha256", pa.array([hashlib.sha256(m).hexdigest() for m in media]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the pages of each file, which stand together, into the file's row."""
    held: list[dict] = []

    def folded() -> dict:
        data = b"".join(p["pixels"] for p in held)
        return {k: held[0][k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")} | {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:]), "feature": _feature(data, len(held))}

    names = [x.split()[0] for x in _DIGEST.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha256" in n or n == "feature" else pa.int64()) for n in names])
    out: list[dict] = []
    for batch in page_batches(_with_digest(store_batches(batches))):
        for row in batch.to_pylist():
            if row["page"] < 0:
                raise ValueError(f"a stored document can't be read back: {row['error']}")
            if row["page"] == 0 and held:
                out.append(folded())
                held = []
            held.append(row)
        if len(out) >= 200:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        out.append(folded())
    yield pa.RecordBatch.from_pylist(out, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Each text stored as a file, read back page by page and folded again: write, read and fold in one pass."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, _DIGEST)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
