"""Media columns: ISO base media files (boxes within boxes) held in a binary column, read without decoding payloads.

:func:`pack` stores bytes losslessly as uncompressed 8-bit grey pictures of one video track. :func:`inspect` walks the
nested boxes of any such file, decodes the sample tables (stts, stss, stsc, stsz, stco/co64) and gives codec, duration
and the byte ranges of key frames and samples.

Defined results. A null or empty text is stored as one padded picture. A null or malformed file has null features and an
``error`` text. Repeated rows each get their row; equal texts get equal values. Empty tables give empty tables. Extra
columns pass through; output columns replace columns of the same names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import bound_batches, table

SIDE = 24
PICTURE = SIDE * SIDE
TIMESCALE = 25
KEY_EVERY = 25
PER_CHUNK = 64
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """The bytes, followed by bytes 255 up to a positive multiple of a picture."""
    return data + b"\xff" * (PICTURE - len(data) % PICTURE if len(data) % PICTURE or not data else 0)


def pack(payload: bytes) -> bytes:
    """An ISO media file with one track of 8-bit grey pictures, whose samples are the payload's bytes in order."""
    if not payload or len(payload) % PICTURE:
        raise ValueError("the payload must fill whole pictures")
    n = len(payload) // PICTURE
    keys = range(1, n + 1, KEY_EVERY)
    chunks = -(-n // PER_CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = struct.pack(">6xH16xHHII4xH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 1, b"", 8, -1)
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    runs += [(chunks, n % PER_CHUNK, 1)] if n % PER_CHUNK else []

    def movie(start: int) -> bytes:
        at = [start + k * PER_CHUNK * PICTURE for k in range(chunks)]
        wide = at[-1] >= 1 << 32
        table_of = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", PICTURE, n)),
            full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *at)),
        )
        data = box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1)))
        media = box(
            b"mdia",
            full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"pictures\0"),
            box(b"minf", full(b"vmhd", 0, 1, bytes(8)), data, table_of),
        )
        track = full(b"tkhd", 0, 3, struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        header = full(b"mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", header, box(b"trak", track, media))

    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    start = len(head) + len(movie(0)) + lead
    if start + len(payload) >= 1 << 32:
        start = len(head) + len(movie(1 << 33)) + lead
    return head + movie(start) + box(b"mdat", payload)


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict[bytes, memoryview] = field(default_factory=dict)

    def samples(self) -> list[tuple[int, int]]:
        """(offset, length) of every sample, in order."""
        fixed, n = struct.unpack_from(">II", self.tables[b"stsz"])
        sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", self.tables[b"stsz"], 8))
        wide = b"co64" in self.tables
        at = self.tables[b"co64" if wide else b"stco"]
        (chunks,) = struct.unpack_from(">I", at)
        offsets = struct.unpack_from(f">{chunks}{'Q' if wide else 'I'}", at, 4)
        (runs,) = struct.unpack_from(">I", self.tables[b"stsc"])
        steps = [struct.unpack_from(">III", self.tables[b"stsc"], 4 + 12 * k) for k in range(runs)]
        out: list[tuple[int, int]] = []
        for k, (first, per, _) in enumerate(steps):
            for chunk in range(first - 1, steps[k + 1][0] - 1 if k + 1 < runs else chunks):
                pos = offsets[chunk]
                for size in sizes[len(out) : len(out) + per]:
                    out.append((pos, size))
                    pos += size
        if len(out) != n:
            raise ValueError("sample tables disagree")
        return out

    def keys(self, n: int) -> list[int]:
        """0-based numbers of key frames; all samples where there is no stss."""
        if b"stss" not in self.tables:
            return list(range(n))
        (k,) = struct.unpack_from(">I", self.tables[b"stss"])
        return [x - 1 for x in struct.unpack_from(f">{k}I", self.tables[b"stss"], 4)]

    def length(self) -> int:
        """Ticks, summed over stts."""
        (k,) = struct.unpack_from(">I", self.tables[b"stts"])
        flat = struct.unpack_from(f">{2 * k}I", self.tables[b"stts"], 4)
        return sum(a * b for a, b in zip(flat[::2], flat[1::2], strict=True))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes in a range."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box is longer than what holds it")
        yield kind, body, stop
        start = stop


def tracks(media: bytes) -> list[Track]:
    """The tracks of a file, found by descending through its boxes."""
    data, found = memoryview(media), []

    def descend(start: int, end: int, track: Track | None) -> None:
        for kind, a, b in walk(data, start, end):
            if kind == b"trak":
                found.append(Track())
                descend(a, b, found[-1])
            elif kind in NESTED:
                descend(a, b, track)
            elif track is not None:
                if kind == b"mdhd":
                    track.timescale, track.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
                elif kind == b"hdlr":
                    track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
                elif kind == b"stsd":
                    for codec, x, y in walk(data, a + 8, b):
                        track.codec = codec.decode("latin-1")
                        if track.handler == "vide" and y - x >= 28:
                            track.width, track.height = struct.unpack_from(">HH", data, x + 24)
                        break
                elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64"):
                    track.tables[kind] = data[a + 4 : b]

    descend(0, len(data), None)
    return found


def key_ranges(track: Track, samples: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [samples[k] for k in track.keys(len(samples))]


def read_back(media: bytes, track: Track, samples: list[tuple[int, int]]) -> bytes:
    """The samples' bytes; neighbouring samples are taken as one slice."""
    data, runs = memoryview(media), []
    for at, size in samples:
        if at + size > len(data):
            raise ValueError("a sample lies outside the file")
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return b"".join(data[a:b] for a, b in runs)


INSPECTED = "codec string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, error string"


def inspected(media: bytes | None) -> tuple:
    try:
        if media is None:
            raise ValueError("no file")
        t = tracks(media)[0]
        s = t.samples()
        return t.codec, t.width, t.height, t.timescale, t.length(), len(s), [{"offset": a, "length": b} for a, b in key_ranges(t, s)], None
    except (ValueError, IndexError, KeyError, struct.error) as e:
        return None, None, None, None, None, None, None, str(e) or type(e).__name__


def to_media(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pack(padded((t or "").encode())))


def inspect(files: pd.Series) -> pd.DataFrame:
    """Codec, size, duration and key frames' byte ranges of ISO media files; no payload is decoded."""
    names = [x.split()[0] for x in INSPECTED.split(", ")]
    out = pd.DataFrame([inspected(x) for x in files], columns=names, dtype=object)
    return out.astype({x: "Int64" for x in ("width", "height", "timescale", "duration", "n_samples")})


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, timescale long, keyframes string"


def digest(files: pd.Series) -> pd.DataFrame:
    """What a file holds, from its stored bytes alone."""
    rows = []
    for media in files:
        t = tracks(media)[0]
        samples = t.samples()
        payload = read_back(media, t, samples)
        keys = key_ranges(t, samples)
        ranges = ",".join(f"{a}+{b}" for a, b in keys)
        feature = f"codec={t.codec.strip()};size={t.width}x{t.height};duration={t.length()}/{t.timescale};samples={len(samples)};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]}"
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, t.codec, t.length(), t.timescale, ranges))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])


def store(documents: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``documents`` with each whole text as an ISO media file in the binary column ``media``."""
    bound_batches(documents.sparkSession)
    return documents.withColumn(media, F.pandas_udf(to_media, "binary")(F.col(f"`{text}`")))


def with_features(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` with what :func:`inspect` finds in the binary column."""
    bound_batches(files.sparkSession)
    return files.withColumn("media_info", F.pandas_udf(inspect, INSPECTED)(F.col(f"`{media}`")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", n.alias("n_bytes"), F.pandas_udf(digest, DIGEST)("media").alias("d")).select("doc_id", "n_bytes", "d.*")
