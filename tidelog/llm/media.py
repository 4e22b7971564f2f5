"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over a blob. Each hit is only a suspicion; a validator per format walks
the structure (chunk lengths, header sizes, checksums) and either gives the
exact length of the file that starts there or refuses it. The first valid file
at offset 0 corrects the declared type; valid files further in are carved out,
those inside the body of another one, too.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import in_slices, keyed_text, table

#: Payloads are padded with spaces to whole rows of 64 RGB pixels.
UNIT = 192
PAD = b"\x20"
#: Media types and the magic bytes at the start of their files.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/bmp": b"BM",
    "image/gif": b"GIF8",
    "audio/wav": b"RIFF",
    "application/zip": b"PK\x03\x04",
    "application/gzip": b"\x1f\x8b\x08",
    "application/pdf": b"%PDF-1.",
    "image/x-portable-pixmap": b"P6\n",
    "image/jpeg": b"\xff\xd8\xff",
    "image/webp": b"RIFF",
    "audio/ogg": b"OggS",
    "video/mp4": b"ftyp",
}
#: Where the magic bytes stand, if not at the start.
MAGIC_AT = {"video/mp4": 4}
#: The end of a JPEG's coded data: a marker that isn't a stuffed byte or a restart.
_JPEG_MARK = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
UNKNOWN = "application/octet-stream"
#: Compressed bytes that are inflated at once.
PIECE = 1 << 16


class Found(NamedTuple):
    """A file inside a blob, and where the file around it starts, if there is one."""

    kind: str
    start: int
    length: int
    inside: int | None = None


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, pos)
        name, end = b[pos + 4 : pos + 8], pos + 12 + size
        if end > len(b) or (name == b"IHDR") != first:
            return None
        if zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if name == b"IEND":
            return end - at
        pos, first = end, False
    return None


def _bmp(b: bytes, at: int) -> int | None:
    """File size, header size, planes, depth and pixel area agree."""
    if at + 54 > len(b):
        return None
    size, zero, offset, header, width, height, planes, depth, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or header != 40 or planes != 1 or packing or depth not in (8, 24, 32) or width <= 0 or not height:
        return None
    area = (width * depth + 31) // 32 * 4 * abs(height)
    return size if size == offset + area and offset >= 54 and at + size <= len(b) else None


def _gif(b: bytes, at: int) -> int | None:
    """Screen, colour tables, extensions and images up to the trailer."""
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return None
    pos = at + 13 + (3 * 2 << (b[at + 10] & 7) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 * 2 << (b[pos + 9] & 7) if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _wav(b: bytes, at: int) -> int | None:
    """A RIFF of form WAVE whose chunks fill the stated length."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, names = at + 12, []
    while pos + 8 <= end <= len(b):
        size = struct.unpack_from("<I", b, pos + 4)[0]
        names.append(b[pos : pos + 4])
        pos += 8 + size + (size & 1)
    return end - at if pos == end and names[:1] == [b"fmt "] and b"data" in names else None


def _webp(b: bytes, at: int) -> int | None:
    """A RIFF of form WEBP whose chunks, of which the first is a picture, fill the stated length."""
    if at + 16 > len(b) or b[at + 8 : at + 15] != b"WEBPVP8":
        return None
    end, pos = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while pos + 8 <= end <= len(b):
        size = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return end - at if pos == end else None


def _jpeg(b: bytes, at: int) -> int | None:
    """Segments with their lengths, a frame and a scan among them, up to the end marker."""
    pos, frame, scan = at + 2, False, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or mark < 0xC0:
            return None
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if mark == 0xDA:
            scan = True
            if not (found := _JPEG_MARK.search(b, pos)):
                return None
            pos = found.end() - 2
        if b[pos : pos + 2] == b"\xff\xd9":
            return pos + 2 - at if frame and scan else None
    return None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages from a first one to a last one."""
    pos = at
    while b[pos : pos + 5] == b"OggS\x00" and pos + 27 <= len(b):
        flags, segments = b[pos + 5], b[pos + 26]
        if (pos == at) != bool(flags & 2):  # only the first page begins a stream
            return None
        pos += 27 + segments + sum(b[pos + 27 : pos + 27 + segments])
        if pos > len(b):
            return None
        if flags & 4:
            return pos - at
    return None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes from the file type on, as long as they fit, with a movie among them."""
    pos, names = at, []
    # another file type begins another file
    while pos + 8 <= len(b) and b[pos + 4 : pos + 8].isalnum() and not (names and b[pos + 4 : pos + 8] == b"ftyp"):
        size = struct.unpack_from(">I", b, pos)[0]
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
        if size < 8 or pos + size > len(b):
            break
        names.append(b[pos + 4 : pos + 8])
        pos += size
    return pos - at if names[:1] == [b"ftyp"] and b"moov" in names else None


@functools.lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Start to end of the archives whose end-of-directory records say where they start; one look at each record of a blob."""
    found: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while 0 <= end <= len(b) - 22:
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - size - start
        if 0 <= at < end and end + 22 + note <= len(b) and b[end - size : end - size + 4] == b"PK\x01\x02":
            found.setdefault(at, end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 4)
    return found


def _zip(b: bytes, at: int) -> int | None:
    """Ends at the first end-of-directory record whose offsets lead back here."""
    end = _zip_ends(b).get(at)
    return None if end is None else end - at


@functools.lru_cache(maxsize=1)
def _last_zero(b: bytes) -> int:
    return b.rfind(b"\x00")


def _gzip(b: bytes, at: int) -> int | None:
    """One member that inflates to its own checksum and length, read in short pieces; a name or remark must end somewhere."""
    if at + 18 > len(b) or b[at + 3] & 0xE0 or b[at + 3] & 0x18 and _last_zero(b) < at + 10:
        return None
    inflate, view = zlib.decompressobj(31), memoryview(b)
    try:
        for pos in range(at, len(b), PIECE):
            block = view[pos : pos + PIECE]
            while len(block) and not inflate.eof:
                inflate.decompress(block, 1 << 20)
                block = inflate.unconsumed_tail
            if inflate.eof:
                return min(pos + PIECE, len(b)) - at - len(inflate.unused_data)
    except zlib.error:
        pass
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before another file's start, with a cross-reference start before it."""
    after = b.find(MAGIC["application/pdf"], at + 1)
    end = b.rfind(b"%%EOF", at, after if after > 0 else len(b))
    return end + 5 - at if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


def _ppm(b: bytes, at: int) -> int | None:
    """Three numbers and the samples they call for."""
    head = b[at + 3 : at + 40].split(None, 3)
    if len(head) < 3 or not all(x.isdigit() for x in head[:3]) or head[2] != b"255":
        return None
    start = 3
    for x in head[:3]:
        start = b.index(x, at + start) + len(x) - at
    size = start + 1 + 3 * int(head[0]) * int(head[1])
    return size if at + size <= len(b) else None


VALIDATE: dict[str, Callable[[bytes, int], int | None]] = {
    "image/png": _png,
    "image/bmp": _bmp,
    "image/gif": _gif,
    "audio/wav": _wav,
    "application/zip": _zip,
    "application/gzip": _gzip,
    "application/pdf": _pdf,
    "image/x-portable-pixmap": _ppm,
    "image/jpeg": _jpeg,
    "image/webp": _webp,
    "audio/ogg": _ogg,
    "video/mp4": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    """All magic bytes; byte strings stand as Latin-1 text of equal length."""
    built = ahocorasick.Automaton()
    kinds: dict[bytes, list[str]] = {}
    for kind, magic in MAGIC.items():
        kinds.setdefault(magic, []).append(kind)
    for magic, shared in kinds.items():
        built.add_word(magic.decode("latin-1"), (shared, len(magic) + MAGIC_AT.get(shared[0], 0)))
    built.make_automaton()
    return built


def sniff(blob: bytes, built: ahocorasick.Automaton) -> list[Found]:
    """Valid files in a blob, left to right; a file that starts inside another one lies inside it whole."""
    found: list[Found] = []
    around: list[Found] = []
    for last, (kinds, size) in built.iter(blob.decode("latin-1")):
        start = last + 1 - size
        if start < 0:
            continue
        while around and around[-1].start + around[-1].length <= start:
            around.pop()
        end = around[-1].start + around[-1].length if around else len(blob)
        for kind in kinds:
            length = VALIDATE[kind](blob, start)
            if length and start + length <= end and not (around and start == around[-1].start):
                found.append(Found(kind, start, length, around[-1].start if around else None))
                around.append(found[-1])
                break
    return found


def encode_png(payload: bytes) -> bytes:
    """A 64 pixel wide RGB image whose rows, in order, are the payload."""
    rows = b"".join(b"\x00" + payload[i : i + UNIT] for i in range(0, len(payload), UNIT))

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", 64, len(payload) // UNIT, 8, 2, 0, 0, 0)
    return MAGIC["image/png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def encode_bmp(payload: bytes) -> bytes:
    """A 24-bit bitmap, top row first, 64 pixels wide."""
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 54, 40, 64, -(len(payload) // UNIT), 1, 24, 0, len(payload), 0, 0, 0, 0) + payload


def encode_wav(payload: bytes) -> bytes:
    """8-bit mono samples at 8 kHz."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


ENCODE = {"image/png": encode_png, "image/bmp": encode_bmp, "audio/wav": encode_wav}


def samples(kind: str, media: bytes) -> bytes:
    """The 8-bit samples of a file that its validator has passed."""
    if kind == "audio/wav":
        pos = 12
        while media[pos : pos + 4] != b"data":
            pos += 8 + (n := struct.unpack_from("<I", media, pos + 4)[0]) + (n & 1)
        return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]
    if kind == "image/bmp":
        return media[struct.unpack_from("<I", media, 10)[0] :]
    if kind == "image/png":
        pos, data = 8, b""
        while media[pos + 4 : pos + 8] != b"IEND":
            size = struct.unpack_from(">I", media, pos)[0]
            if media[pos + 4 : pos + 8] == b"IDAT":
                data += media[pos + 8 : pos + 8 + size]
            pos += 12 + size
        rows = zlib.decompress(data)
        if any(rows[:: UNIT + 1]):
            raise ValueError("only unfiltered rows are read")
        return b"".join(rows[i + 1 : i + 1 + UNIT] for i in range(0, len(rows), UNIT + 1))
    raise ValueError(f"no sample reader for {kind}")


STORED = "id long, n_bytes long, declared string, media binary"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: `id, n_bytes, declared, media`.

    The UTF-8 bytes (null: none) are padded with spaces to a positive multiple
    of 192 and stored in a format picked by their checksum. The declared type
    is always the bitmap type, so two thirds of the rows carry a wrong one.
    Equal texts give equal media. Columns other than the two named are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = list(ENCODE)
        for batch in batches:
            for part in in_slices(batch, 1):
                raw = [t.encode() for t in part.column(1).to_pylist()]
                padded = [t + PAD * (max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t)) for t in raw]
                media = [ENCODE[kinds[zlib.crc32(p) % len(kinds)]](p) for p in padded]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(["image/bmp"] * len(raw)), pa.array(media, pa.binary())],
                    ["id", "n_bytes", "declared", "media"],
                )

    return keyed_text(df, id_col, text_col).mapInArrow(run, STORED)


SNIFFED = (
    "id long, n_bytes long, declared string, kind string, start long, length long, "
    "carved array<struct<kind:string,start:long,length:long,inside:long>>, media binary"
)


def sniff_column(stored: DataFrame) -> DataFrame:
    """The real type of each blob of `id, n_bytes, declared, media`.

    `kind` is the format proved at the start of the blob, or else of the first
    file carved from it, at `start` over `length` bytes; a blob with none keeps
    the unknown type and its whole length. `carved` lists every valid file. A
    null blob counts as empty. Blobs are scanned whole; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton()
        for batch in (part for whole in batches for part in in_slices(whole, 3)):
            blobs = [b or b"" for b in batch.column(3).to_pylist()]
            found = [sniff(b, built) for b in blobs]
            first = [f[0] if f else Found(UNKNOWN, 0, len(b)) for f, b in zip(found, blobs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    pa.array([f.kind for f in first], pa.string()),
                    pa.array([f.start for f in first], pa.int64()),
                    pa.array([f.length for f in first], pa.int64()),
                    pa.array([[f._asdict() for f in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("inside", pa.int64())]))),
                    pa.array(blobs, pa.binary()),
                ],
                ["id", "n_bytes", "declared", "kind", "start", "length", "carved", "media"],
            )

    return stored.select("id", "n_bytes", "declared", "media").mapInArrow(run, SNIFFED)


READ = (
    "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, declared string, kind string, carved_files long"
)


def read_features(sniffed: DataFrame) -> DataFrame:
    """Decode each blob by its proved type and digest what was read.

    `feature` is the proved type, whether the declared one was corrected, and
    the sample count, sum and number of distinct values of the samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in in_slices(whole, 7)):
            out = []
            for row in batch.to_pylist():
                blob = row["media"]
                data = samples(row["kind"], blob[row["start"] : row["start"] + row["length"]])
                said = "kept" if row["kind"] == row["declared"] else "corrected"
                out.append(
                    {
                        "id": row["id"],
                        "n_bytes": row["n_bytes"],
                        "payload_bytes": len(data),
                        "payload_sha256": hashlib.sha256(data).hexdigest(),
                        "tail_crc32": zlib.crc32(data[-16:]),
                        "media_bytes": len(blob),
                        "media_sha256": hashlib.sha256(blob).hexdigest(),
                        "feature": f"{row['kind']};{said};n={len(data)};adler={zlib.adler32(data):08x};values={len(set(data))}",
                        "declared": row["declared"],
                        "kind": row["kind"],
                        "carved_files": len(row["carved"]),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    arrow_schema = pa.schema(
        [(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in READ.split(", "))]
    )
    return sniffed.mapInArrow(run, READ)


def op1_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` stored as media, sniffed and read back."""
    read = read_features(sniff_column(store_texts(table(spark, sf_dir, "documents"))))
    return read.withColumnRenamed("id", "doc_id")
