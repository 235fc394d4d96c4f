"""TIFF columns: image directories, strips and tiles, PackBits, LZW and deflate, and predictors, to one row per page."""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_short_batches, table

#: Tags and values of the format (fixed values).
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q", 18: "Q"}
#: LZW codes of the format (fixed values): clear, end, first free, widest.
CLEAR, END, FREE, WIDEST = 256, 257, 258, 12

#: Of a stored payload: samples in a row, most rows on a page, rows in a strip, edge of a tile.
ROW, PAGE_ROWS, STRIP_ROWS, TILE = 576, 1024, 64, 64


#: The tags that are read; values of others are not looked at.
READ_TAGS = frozenset((WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES))
#: Bytes that one stored byte can stand for at most: a code of 9 bits or more for a string of under 4096; two bytes for 128; deflate's longest match of 258 in two bits.
MOST_FROM_A_BYTE = {NONE: 1, LZW: 4096, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032}


class BadTiff(ValueError):
    """The bytes are not a TIFF that can be read."""


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as a count and the byte, the rest as literals of at most 128."""
    out, at = bytearray(), 0

    def literals(upto: int) -> None:
        nonlocal at
        while at < upto:
            n = min(128, upto - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literals(m.start())
        out.extend((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


#: Of the codes since the last clear the widths (the width grows one code early, as the format has it) and where each begins.
_WIDTHS = np.repeat(np.arange(9, WIDEST + 1), [(1 << 9) - FREE, 1 << 9, 1 << 10, 1 << 12])
_BEGINS = np.cumsum(_WIDTHS) - _WIDTHS
#: Codes after which the writer clears its table.
_FULL = (1 << WIDEST) - FREE
_SINGLES = [*(bytes((k,)) for k in range(256)), b"", b""]


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first."""
    codes, since = [CLEAR], [0]  # the first clear is of the width of a first code
    longer: dict[int, int] = {}
    run, n = -1, 0
    for byte in data:
        if run < 0:
            run = byte
            continue
        key = run << 8 | byte
        found = longer.get(key)
        if found is not None:
            run = found
            continue
        codes.append(run)
        longer[key] = FREE + n
        n += 1
        if n == _FULL:
            codes.append(CLEAR)
            since.append(len(codes))
            longer, n = {}, 0
        run = byte
    if run >= 0:
        codes.append(run)
    codes.append(END)
    since = [0, 1, *since[1:], len(codes)]
    widths = np.concatenate([_WIDTHS[: b - a] for a, b in zip(since, since[1:], strict=False)])
    bit = widths[:, None] - 1 - np.arange(WIDEST)
    return np.packbits((np.array(codes)[:, None] >> np.maximum(bit, 0) & 1)[bit >= 0].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """The first ``size`` bytes at most. Codes are taken from the bits some thousands at a time, up to the next clear."""
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    out, made = [], 0
    strings, last = list(_SINGLES), b""
    bit, since, bits = 0, 0, 8 * len(data)
    while made < size:
        at = np.arange(since, since + 4096)
        known = np.minimum(at, len(_WIDTHS) - 1)
        width, begin = _WIDTHS[known], bit + _BEGINS[known] - _BEGINS[known[0]] + WIDEST * (at - known - (since - known[0]))
        begin, width = begin[begin + width <= bits], width[: np.count_nonzero(begin + width <= bits)]
        if not len(begin):
            break
        byte = begin >> 3
        codes = (padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]) >> (24 - (begin & 7) - width) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else len(codes)
        for code in codes[:n].tolist():
            if code < len(strings):
                string = strings[code]
            elif code == len(strings) and last:
                string = last + last[:1]
            else:
                raise BadTiff(f"LZW code {code} is not known")
            if last:
                strings.append(last + string[:1])
            out.append(string)
            made += len(string)
            last = string
        if not len(stops):
            since += n
            bit = int(begin[-1] + width[-1])
        elif codes[n] == END:
            break
        else:
            bit, since = int(begin[n] + width[n]), 0
            strings, last = list(_SINGLES), b""
    return b"".join(out)[:size]


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[scheme](data) if scheme not in (DEFLATE, OLD_DEFLATE) else zlib.compress(data, 1)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme == PACKBITS:
        return packbits_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from e
    raise BadTiff(f"compression {scheme} is not known")


@dataclass
class Page:
    """One image: rows x columns x samples, as stored."""

    page: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray


def _entries(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple[int, ...]], int]:
    """An image directory's tags with their values, and where the next one is."""
    count, head, size, where = ("Q", 8, 20, "Q") if big else ("H", 2, 12, "I")
    (n,) = struct.unpack_from(order + count, data, at)
    at += head
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + "HH" + where, data, at + k * size)
        if kind not in KINDS or tag not in READ_TAGS:
            continue
        form = f"{order}{many}{KINDS[kind]}"
        inline = at + k * size + (12 if big else 8)
        place = inline if struct.calcsize(form) <= (8 if big else 4) else struct.unpack_from(order + where, data, inline)[0]
        tags[tag] = struct.unpack_from(form, data, place)
    return tags, struct.unpack_from(order + where, data, at + n * size)[0]


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a classic or big TIFF of either byte order: 8, 16 or 32 bits a sample, strips or tiles, chunky samples."""
    try:
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise BadTiff("no byte order mark")
        order = "<" if data[:2] == b"II" else ">"
        magic = struct.unpack_from(order + "H", data, 2)[0]
        if magic not in (42, 43):
            raise BadTiff(f"version {magic} is not known")
        at = struct.unpack_from(order + ("Q" if magic == 43 else "I"), data, 8 if magic == 43 else 4)[0]
        seen: set[int] = set()
        while at:
            if at in seen:
                raise BadTiff("the image directories go in a circle")
            seen.add(at)
            tags, at = _entries(data, at, order, magic == 43)
            yield _page(data, tags, order, len(seen) - 1)
    except (struct.error, KeyError, IndexError, OverflowError) as e:
        raise BadTiff(f"cut short or incomplete: {e!r}") from e


def _checked(tags: dict[int, tuple[int, ...]], tag: int, default: int | None = None) -> int:
    """The first value of a tag, a whole number of at least 1."""
    value = tags[tag][0] if tag in tags or default is None else default
    if not isinstance(value, int) or value < 1:
        raise BadTiff(f"tag {tag} is {value!r}")
    return value


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str, number: int) -> Page:
    """One image. Nothing is allocated before it is known that the stored bytes can yield as much."""
    width, length, samples = _checked(tags, WIDTH), _checked(tags, LENGTH), _checked(tags, SAMPLES, 1)
    scheme, predictor, bits = _checked(tags, COMPRESSION, NONE), _checked(tags, PREDICTOR, 1), tags.get(BITS, (1,))
    if len(set(bits)) != 1 or bits[0] not in (8, 16, 32) or _checked(tags, PLANAR, 1) != 1 or predictor not in (1, 2):
        raise BadTiff("only chunky samples of 8, 16 or 32 bits, with horizontal differences at most")
    if scheme not in MOST_FROM_A_BYTE:
        raise BadTiff(f"compression {scheme} is not known")
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        wide, high, offsets, sizes = _checked(tags, TILE_WIDTH), _checked(tags, TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        wide, high, offsets, sizes = width, min(length, _checked(tags, ROWS_PER_STRIP, length)), tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    across, down = -(-width // wide), -(-length // high)
    if not len(offsets) == len(sizes) == across * down:
        raise BadTiff(f"{across * down} strips or tiles with {len(offsets)} places and {len(sizes)} sizes")
    if not all(isinstance(x, int) and x >= 0 for x in (*offsets, *sizes)):
        raise BadTiff("a place or size of a strip or tile is no number")
    stored = [data[offset : offset + size] for offset, size in zip(offsets, sizes, strict=True)]
    rows_of = [high if tiled else min(high, length - k * high) for k in range(down) for _ in range(across)]
    wants = [rows * wide * samples * kind.itemsize for rows in rows_of]
    if any(want > len(block) * MOST_FROM_A_BYTE[scheme] for want, block in zip(wants, stored, strict=True)):
        raise BadTiff("a strip or tile is cut short")
    image = np.zeros((length, width, samples), dtype=kind.newbyteorder("="))
    for k, (rows, want) in enumerate(zip(rows_of, wants, strict=True)):
        top, left = k // across * high, k % across * wide
        block = decompress(stored[k], scheme, want)
        if len(block) < want:
            raise BadTiff("a strip or tile is cut short")
        part = np.frombuffer(block, dtype=kind, count=want // kind.itemsize).reshape(rows, wide, samples).astype(image.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=image.dtype)
        image[top : top + rows, left : left + wide] = part[: length - top, : width - left]
    return Page(number, scheme, predictor, tiled, image)


@dataclass(frozen=True)
class Form:
    """How a page is stored: compression, predictor (2: differences), edge of its tiles (a multiple of 16; 0: strips)."""

    scheme: int
    predictor: int = 1
    tile: int = 0


#: The forms that pages of payloads take by turns, whatever their size.
FORMS = (Form(DEFLATE, 2), Form(PACKBITS, 1, TILE), Form(LZW))


def write_tiff(pages: Iterable[np.ndarray], forms: Sequence[Form], *, strip_rows: int = STRIP_ROWS) -> bytes:
    """A classic little-endian TIFF of 8-bit grey pages, which take the forms by turns."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, form in zip(pages, itertools.cycle(forms)):
        scheme, predictor, tile = form.scheme, form.predictor, form.tile
        length, width = image.shape
        blocks = []
        if tile:
            padded = np.zeros((-(-length // tile) * tile, -(-width // tile) * tile), dtype=np.uint8)
            padded[:length, :width] = image
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [image[y : y + strip_rows] for y in range(0, length, strip_rows)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), dtype=np.uint8))
            stored = compress(np.ascontiguousarray(block).tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(stored))
            out += stored + b"\0" * (len(stored) % 2)
        tags: dict[int, tuple[int, ...]] = {WIDTH: (width,), LENGTH: (length,), BITS: (8,), COMPRESSION: (scheme,), PHOTOMETRIC: (1,), SAMPLES: (1,), PREDICTOR: (predictor,)}
        tags |= {TILE_WIDTH: (tile,), TILE_LENGTH: (tile,), TILE_OFFSETS: tuple(offsets), TILE_BYTES: tuple(sizes)} if tile else {STRIP_OFFSETS: tuple(offsets), ROWS_PER_STRIP: (strip_rows,), STRIP_BYTES: tuple(sizes)}
        places = {}
        for tag, values in tags.items():
            if len(values) > 1:
                places[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, values in sorted(tags.items()):
            out += struct.pack("<HHII", tag, 4, len(values), places.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store_payload(text: str | None, forms: Sequence[Form] = FORMS) -> bytes:
    """A text's UTF-8 bytes, with bytes 255 up to a positive multiple of ``ROW``, as a TIFF.

    Pages take the forms by turns, beginning at one that the payload's checksum names, so all sizes go through all codecs.
    """
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % ROW or (0 if raw else ROW))
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    first = zlib.crc32(payload) % len(forms)
    return write_tiff([image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)], [*forms[first:], *forms[:first]])


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c for c in batch.schema.names if c != "_text"]
        texts = batch.column(batch.schema.get_field_index("_text"))
        for k in range(0, len(batch), 500):
            media = [store_payload(t.as_py()) for t in texts[k : k + 500]]
            part = batch.slice(k, len(media))
            sizes = [len((t.as_py() or "").encode()) for t in texts[k : k + 500]]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*columns, "n_bytes", "media"])


def store_media(docs: DataFrame, keep: list[str], *, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_bytes`` and ``media``, the text as a TIFF.

    A null text is stored like an empty one, a text of any length as pages of ``PAGE_ROWS`` rows. Rows are stored each by itself, so that equal texts, repeated
    rows among them, have equal bytes; an empty table gives no rows. Other columns are ignored.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return in_short_batches(docs).select(*[F.col(c) for c in keep], F.col(text).alias("_text")).mapInArrow(_store, schema)


_PAGE_FIELDS = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]


def page_rows(data: bytes | None) -> Iterator[tuple]:
    """A row for each page; where reading fails, a last row with the error and no pixels."""
    number = 0
    try:
        if data is None:
            raise BadTiff("null")
        for p in read_tiff(data):
            number = p.page + 1
            yield (p.page, p.samples.shape[1], p.samples.shape[0], p.samples.shape[2], p.compression, p.predictor, p.tiled, p.samples.tobytes(), None)
    except BadTiff as e:
        yield (number, None, None, None, None, None, None, None, str(e))


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(batch: pa.RecordBatch, index: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = batch.take(pa.array(index, pa.int64()))
        columns = [c for c in batch.schema.names if c != "_media"]
        return pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(_PAGE_FIELDS))], names=[*columns, *(n for n, _ in _PAGE_FIELDS)])

    for batch in batches:
        index, rows, size = [], [], 0
        for k, media in enumerate(batch.column(batch.schema.get_field_index("_media"))):
            for row in page_rows(media.as_py()):
                index.append(k)
                rows.append(row)
                size += len(row[7] or b"")
                if size > 8_000_000:
                    yield made(batch, index, rows)
                    index, rows, size = [], [], 0
        if rows:
            yield made(batch, index, rows)


def tiff_pages(df: DataFrame, keep: list[str], *, media: str = "media") -> DataFrame:
    """One row per page of the TIFFs in ``media``: columns ``keep`` and ``page, width, height, samples, compression, predictor, tiled, pixels, error``.

    Bytes that are null, cut short or not TIFF, and headers that contradict themselves or the bytes stored (sizes of 0, images larger than the stored bytes can yield, numbers of strips that don't fit), give
    the pages read so far and one row with ``error`` set and null pixels. Repeated rows are read each; an empty table gives no rows; other columns are ignored.
    """
    kinds = {"page": "integer", "width": "integer", "height": "integer", "samples": "integer", "compression": "integer", "predictor": "integer", "tiled": "boolean", "pixels": "binary", "error": "string"}
    schema = T.StructType([df.schema[c] for c in keep])
    for n, t in kinds.items():
        schema = schema.add(n, t)
    return df.select(*[F.col(c) for c in keep], F.col(media).alias("_media")).mapInArrow(_explode, schema)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: stored bytes, read back page by page, and features of the samples."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for value in batch.column(batch.schema.get_field_index("media")):
            media = value.as_py()
            sha, size, tail, pages, counts, kinds = hashlib.sha256(), 0, b"", 0, np.zeros(256, dtype=np.int64), set()
            for row in page_rows(media):
                if row[8]:
                    raise BadTiff(row[8])
                sha.update(row[7])
                size, tail, pages = size + len(row[7]), row[7][-32:], pages + 1
                kinds.add(row[4])
                counts += np.bincount(np.frombuffer(row[7], dtype=np.uint8), minlength=256)
            p = counts[counts > 0] / max(1, size)
            mean = float(counts @ np.arange(256)) / max(1, size)
            feature = f"pages={pages};compression={','.join(map(str, sorted(kinds)))};mean={mean:.4f};entropy={-float(p @ np.log2(p)):.4f};distinct={len(p)}"
            for n, v in zip(out, (size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                out[n].append(v)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [c for c in batch.schema.names if c != "media"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=[*names, *out])


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key = docs.schema["doc_id"].dataType.simpleString()
    stored = store_media(docs, ["doc_id"])
    return stored.mapInArrow(_digest, f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
