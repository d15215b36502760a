"""Media columns: texts stored in ISO media containers, and a reader that indexes such containers.

The writer puts a payload, without loss, into a file with one video track of uncompressed 8 by 8
frames of 8-bit samples (64 bytes a frame). The reader walks nested boxes, decodes the sample tables
and gives codec, duration and the byte ranges of keyframes without touching the payload.

Nulls and odd inputs: a null text is an empty payload, stored as one frame of zeros; null or malformed
media give a row with `error` set and the other fields null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.words import text_batches

FRAME = 64
RATE = 25  # frames a second
KEY_EVERY = 16
CHUNK = 256  # frames in a chunk
DEPTH = 32  # of boxes in boxes that the reader follows
#: Fixed values of the container format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"moof", b"traf", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(values, width: str = ">u4") -> bytes:
    return np.asarray(values, dtype=width).tobytes()


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % FRAME if payload else FRAME)


def write_media(payload: bytes) -> bytes:
    """A container around a payload whose length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    last = frames - CHUNK * (chunks - 1)
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    keys = range(1, frames + 1, KEY_EVERY)

    def movie(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        far = int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), table(keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), table(runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, frames)),
            full_box(b"co64" if far else b"stco", struct.pack(">I", chunks), table(offsets, ">u8" if far else ">u4")),
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), dinf, stbl)
        hdlr = full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0")
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), hdlr, minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(movie(0))
    moov = movie(len(head) + size + lead)
    if len(moov) != size:  # the offsets needed 64 bits
        moov = movie(len(head) + len(moov) + lead)
    return head + moov + box(b"mdat", payload)


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first."""
    open_boxes: list[tuple[tuple[bytes, ...], int]] = [((), len(data))]
    start = 0
    while open_boxes:
        path, end = open_boxes[-1]
        if start + 8 > end:
            if start != end and path:
                raise ValueError(f"{end - start} bytes left over in {path[-1]!r}")
            open_boxes.pop()
            start = end
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:  # to the end of the file
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} doesn't fit")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            if len(open_boxes) > DEPTH:
                raise ValueError(f"boxes more than {DEPTH} deep")
            open_boxes.append(((*path, kind), start + size))
            start = body
        else:
            start += size


def _column(data: memoryview, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def read_tracks(media: bytes) -> list[dict]:
    """Per track: handler, codec, timescale, duration, width, height, and sample arrays `at`, `size`, and `key` (sample numbers from 0)."""
    data, tracks = memoryview(media), []
    for path, a, _ in walk(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            tracks.append({"handler": "", "codec": "", "timescale": 0, "duration": 0, "width": 0, "height": 0, "key": None})
        if b"trak" not in path or path[-1] in CONTAINERS:
            continue
        t = tracks[-1]
        count = struct.unpack_from(">I", data, a + 4)[0] if kind in (b"stsd", b"stts", b"stss", b"stsc", b"stco", b"co64") else 0
        if kind == b"mdhd":
            wide = data[a] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        elif kind == b"hdlr":
            t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and count:
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
            if t["handler"] == "vide":
                t["width"], t["height"] = struct.unpack_from(">HH", data, a + 8 + 32)
        elif kind == b"stts":
            t["stts"] = _column(data, a + 8, 2 * count).reshape(-1, 2)
        elif kind == b"stss":
            t["key"] = _column(data, a + 8, count) - 1
        elif kind == b"stsc":
            t["stsc"] = _column(data, a + 8, 3 * count).reshape(-1, 3)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            if n * max(size, 4 * (size == 0)) > len(data):  # before anything of that size is allocated
                raise ValueError(f"{n} samples don't fit into the file")
            t["size"] = np.full(n, size, np.int64) if size else _column(data, a + 12, n)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _column(data, a + 8, count, ">u8" if kind == b"co64" else ">u4")
    for t in tracks:
        if missing := {"size", "stsc", "chunks"} - t.keys():
            raise ValueError(f"track without {sorted(missing)}")
        first, each = t["stsc"][:, 0] - 1, t["stsc"][:, 1]
        per_chunk = np.repeat(each, np.diff(first, append=len(t["chunks"])))
        if per_chunk.sum() != len(t["size"]):
            raise ValueError("sample counts of stsc and stsz differ")
        before = np.cumsum(t["size"]) - t["size"]
        opens = np.cumsum(per_chunk) - per_chunk
        t["at"] = np.repeat(t["chunks"], per_chunk) + before - np.repeat(before[opens] if len(opens) else opens, per_chunk)
        if len(t["size"]) and (t["at"] + t["size"]).max() > len(data):
            raise ValueError("a sample ends after the file")
        if t["key"] is None:  # no table: every sample is a keyframe
            t["key"] = np.arange(len(t["size"]))
        if len(t["key"]) and not 0 <= t["key"].min() <= t["key"].max() < len(t["size"]):
            raise ValueError("a keyframe that is no sample")
        if not t["duration"] and "stts" in t:
            t["duration"] = int((t["stts"][:, 0] * t["stts"][:, 1]).sum())
    return tracks


def first_track(media: bytes) -> dict:
    tracks = read_tracks(media)
    if not tracks:
        raise ValueError("no track")
    return tracks[0]


def read_payload(media: bytes, t: dict | None = None) -> bytes:
    """The samples of a track, or of the first one, in order; runs of adjoining samples are copied at once."""
    t = t or first_track(media)
    if not len(t["at"]):
        return b""
    breaks = np.flatnonzero(t["at"][1:] != t["at"][:-1] + t["size"][:-1]) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(t["at"]) - 1]])
    return b"".join(media[a:b] for a, b in zip(t["at"][first].tolist(), (t["at"][last] + t["size"][last]).tolist(), strict=True))


def feature(track: dict) -> str:
    """codec, size, duration in seconds, samples and keyframe byte ranges of a track, as text."""
    at, size = track["at"][track["key"]], track["size"][track["key"]]
    ranges = ",".join(f"{a}+{n}" for a, n in zip(at.tolist(), size.tolist(), strict=True))
    return f"{track['codec']};{track['width']}x{track['height']};{track['duration'] / max(track['timescale'], 1):.2f};{len(track['at'])};{ranges}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, 1):
            media = [write_media(pad(t)) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MALFORMED = (ValueError, IndexError, struct.error)
INDEX = "codec string, timescale long, duration double, width int, height int, samples long, keyframes array<struct<start:long,size:long>>, error string"


def index_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns but the media itself, and `media_index`: codec, duration and keyframe byte ranges of the first track."""
    rest = [c for c in df.columns if c not in (media_col, "media_index")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for media in batch.column(len(rest)):
                try:
                    t = first_track(media.as_py() or b"")
                    keys = [{"start": int(a), "size": int(n)} for a, n in zip(t["at"][t["key"]], t["size"][t["key"]], strict=True)]
                    found.append({"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"] / max(t["timescale"], 1), "width": t["width"], "height": t["height"], "samples": len(t["at"]), "keyframes": keys, "error": None})
                except MALFORMED as e:
                    found.append({"error": str(e)})
            kind = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.float64()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("error", pa.string())])
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, kind)], names=[*rest, "media_index"])

    schema = df.select(*rest).schema.add("media_index", df.sparkSession.createDataFrame([], INDEX).schema)
    return df.select(*rest, media_col).mapInArrow(run, schema)


def media_digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> payload and media digests and the feature text, all from the stored bytes, and `error`.

    Null media have no digests; malformed media only those of the stored bytes.
    """
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                stored = media.as_py()
                row = {"media_bytes": None if stored is None else len(stored), "media_sha256": None if stored is None else hashlib.sha256(stored).hexdigest()}
                try:
                    track = first_track(stored or b"")
                    payload = read_payload(stored, track)
                    row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-FRAME:]), "feature": feature(track)}
                except MALFORMED as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([r.get(name) for r in rows], kind) for name, kind in fields)], names=["doc_id", "n_bytes", *(name for name, _ in fields)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
