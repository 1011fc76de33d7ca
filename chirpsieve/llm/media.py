"""Media columns: declared types corrected and embedded media carved by signature sniffing.

One Aho-Corasick pass over a value finds every magic number; a validator per
format then walks the structure and confirms its length, so chance matches in
ordinary bytes are not reported.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Magic numbers and the formats that they begin.
MAGIC = [
    (b"RIFF", "wav"),
    (b"\x89PNG\r\n\x1a\n", "png"),
    (b"GIF87a", "gif"),
    (b"GIF89a", "gif"),
    (b"\xff\xd8\xff", "jpeg"),
    (b"BM", "bmp"),
    (b"fLaC", "flac"),
]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def _wav(b: bytes, at: int, known: dict) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 44:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    while p + 8 <= end <= len(b):
        seen.add(b[p : p + 4])
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    return end - at if p == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int, known: dict) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and kind != b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int, known: dict) -> int:
    if len(b) < at + 14:
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    ends, dead = known.setdefault("gif blocks", {}), known.setdefault("gif dead", set())

    def blocks(p: int) -> int:
        """The end of a chain of blocks; chains that join end alike, so each position is passed once."""
        passed = []
        while p < len(b) and b[p] and p not in ends:
            passed.append(p)
            p += b[p] + 1
        end = ends.get(p, p + 1)
        ends.update(dict.fromkeys(passed, end))
        return end

    passed = []
    while p < len(b) and p not in dead:
        passed.append(p)
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            break
    dead.update(passed)
    return 0


def _jpeg(b: bytes, at: int, known: dict) -> int:
    p, scans, passed, dead = at + 2, False, [], known.setdefault("jpeg dead", set())
    if "jpeg marks" not in known:
        # within a scan stand escaped bytes and restart marks; any other mark ends it
        known["jpeg marks"] = [m.start() for m in _MARK.finditer(b)]
    marks = known["jpeg marks"]
    while p + 2 <= len(b) and b[p] == 0xFF and (p, scans) not in dead:
        passed.append((p, scans))
        kind = b[p + 1]
        if kind == 0xFF:  # a fill byte
            p += 1
        elif kind == 0xD9:
            if scans:
                return p + 2 - at
            break
        elif p + 4 > len(b) or (n := struct.unpack_from(">H", b, p + 2)[0]) < 2:
            break
        else:
            p += 2 + n
            if kind == 0xDA:
                scans, i = True, bisect.bisect_left(marks, p)
                if i == len(marks):
                    break
                p = marks[i]
    dead.update(passed)
    return 0


_MARK = re.compile(rb"\xff(?![\x00\xd0-\xd7])")


def _bmp(b: bytes, at: int, known: dict) -> int:
    if len(b) < at + 26:
        return 0
    n, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= n <= len(b) - at else 0


def _crc_table(bits: int, polynomial: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x >> bits - 1 else x << 1) & (1 << bits) - 1
        out.append(x)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc8(b: bytes) -> int:
    c = 0
    for x in b:
        c = CRC8[c ^ x]
    return c


def crc16(b: bytes) -> int:
    c = 0
    for x in b:
        c = (c << 8 ^ CRC16[c >> 8 ^ x]) & 0xFFFF
    return c


def _flac_frame(b: bytes, p: int) -> tuple[int, int]:
    """(length of the header, samples) of a FLAC frame at p; (0, 0) if there is none: sync code, reserved bits and CRC-8 must be right."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return 0, 0
    size, rate = b[p + 2] >> 4, b[p + 2] & 15
    q, first = p + 5, b[p + 4]
    while first & 0xC0 == 0xC0:  # a number as in UTF-8
        q, first = q + 1, first << 1 & 0xFF
    more = (size == 6) + 2 * (size == 7)
    if q + more > len(b):
        return 0, 0
    n = 192 if size == 1 else 576 << size - 2 if size < 6 else int.from_bytes(b[q : q + more], "big") + 1 if size < 8 else 256 << size - 8
    q += more + (rate == 12) + 2 * (rate in (13, 14))
    return (q + 1 - p, n) if q < len(b) and crc8(b[p:q]) == b[q] else (0, 0)


def _flac(b: bytes, at: int, known: dict) -> int:
    """Blocks, then frames until all samples are there: a frame ends where its CRC-16 is right and the next one begins."""
    p, first, last = at + 4, True, False
    if len(b) < p + 38:
        return 0
    total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
    while not last:
        if p + 4 > len(b):
            return 0
        last, kind, n = b[p] >> 7, b[p] & 127, int.from_bytes(b[p + 1 : p + 4], "big")
        if (kind, n) != (0, 34) if first else kind == 127:
            return 0
        p, first = p + 4 + n, False
    done = 0
    while not total or done < total:
        head, n = _flac_frame(b, p)
        if not head:
            return p - at if done and not total else 0
        done += n
        if "flac sums" not in known:
            sums = same_sums(b)
            starts = [m.start() for m in _SYNC.finditer(b) if _flac_frame(b, m.start())[0]]
            known["flac sums"] = sums, *(np.sort(sums[i] << 40 | i) for i in (np.arange(len(sums)), np.array(starts, dtype=np.int64)))
        sums, every, starts = known["flac sums"]
        # the first end behind the header: any for the last frame, else one where a frame begins
        want, among = sums[p] << 40 | p + head + 1, every if total and done >= total else starts
        i = np.searchsorted(among, want)
        if i < len(among) and among[i] >> 40 == sums[p]:
            p = int(among[i] & (1 << 40) - 1)
        elif not total and sums[-1] == sums[p] and len(b) > p + head:
            p = len(b)
        else:
            return 0
    return p - at


_SYNC = re.compile(rb"\xff[\xf8\xf9]")


@functools.cache
def _powers() -> np.ndarray:
    """x^-i modulo CRC-16's polynomial, for i to its period; once a process, since it takes longer than the sums of a text."""
    unit, back = 1, []
    for _ in range(32767):  # one step divides by x
        back.append(unit)
        unit = (unit ^ 0x18005) >> 1 if unit & 1 else unit >> 1
    return np.array(back, dtype=np.uint16)


def same_sums(b: bytes) -> np.ndarray:
    """A value for each position (the last one is the end) such that the CRC-16 of b[p:q] is 0 where those of p and q are equal.

    The CRC of a prefix, times x^-8 for each of its bytes: so a byte's share
    doesn't depend on where a frame begins, and all shares are one array.
    """
    n = len(b)
    # a byte's share is the byte times x^16, of the CRC, and x^-8 for each byte up to it
    power = _powers()[(8 * np.arange(n, dtype=np.int64) - 8) % 32767]
    byte, share = np.frombuffer(b, np.uint8).astype(np.uint16), np.zeros(n, dtype=np.uint16)
    for bit in range(8):
        share ^= (byte >> bit & 1) * power
        power = power << 1 ^ (power >> 15) * np.uint16(0x8005)
    return np.concatenate([np.zeros(1, np.int64), np.bitwise_xor.accumulate(share).astype(np.int64)]) if n else np.zeros(1, np.int64)


VALID = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "flac": _flac}


def sniff(b: bytes, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each validated medium, outermost only, in order of offset.

    What one start has found out about later bytes is known to the next ones,
    so hostile bytes with very many starts don't take a square of their length.
    """
    out, free, known = [], 0, {}
    hits = sorted((end - n + 1, -n, kind) for end, (n, kind) in a.iter(b.decode("latin-1")))
    for at, _, kind in hits:
        if at >= free and (n := VALID[kind](b, at, known)):
            out.append((kind, at, n))
            free = at + n
    return out


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM; an odd number of samples gets the format's pad byte."""
    n, pad = len(samples), len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + n + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples + b"\0" * pad


def wav_samples(b: bytes) -> bytes:
    p = 12
    while p + 8 <= len(b):
        n = struct.unpack_from("<I", b, p + 4)[0]
        if b[p : p + 4] == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    return b""


def identify(df: DataFrame, content: str, declared: str | None = None, keep: list[str] = ()) -> DataFrame:
    """keep, content, declared, media_type, corrected, embedded (array of type, offset, length).

    media_type is the type whose medium begins at byte 0, else the first carved
    one's, else null; corrected tells that it differs from the declared type.
    Null and empty content: null type, no embedded media. Other columns are
    left out; repeated rows and empty tables stay what they are. Columns of
    these names among `keep` raise.
    """
    clash = {"content", "declared", "media_type", "corrected", "embedded"} & set(keep)
    if clash:
        raise ValueError(f"{sorted(clash)} are made here: rename the columns that are kept")
    from pyspark.sql import functions as F

    src = df.select(*keep, df[content].alias("content"), (df[declared] if declared else F.lit(None).cast("string")).alias("declared"))
    kinds = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        a = automaton()
        for batch in batches:
            types, fixed, found = [], [], []
            for b, said in zip(batch["content"].to_pylist(), batch["declared"].to_pylist()):
                parts = sniff(b or b"", a)
                kind = parts[0][0] if parts else None
                types.append(kind)
                fixed.append(kind is not None and kind != said)
                found.append([{"type": k, "offset": at, "length": n} for k, at, n in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(found, pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))], [*batch.schema.names, "media_type", "corrected", "embedded"])

    return src.mapInArrow(run, kinds + "content binary, declared string, media_type string, corrected boolean, embedded array<struct<type:string,offset:bigint,length:bigint>>")


def built(kind: str, body: bytes) -> bytes:
    """A small medium of each format that carries body as samples, pixels or a comment."""
    if kind == "wav":
        return wav(body)
    if kind == "png":
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"tEXt", b"Comment\0" + body), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")]
        return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x)) for k, x in parts)
    if kind == "gif":
        comment = b"".join(bytes([len(x)]) + x for x in (body[i : i + 255] for i in range(0, len(body), 255)))
        return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"!\xfe" + comment + b"\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
    if kind == "jpeg":
        comments = b"".join(b"\xff\xfe" + struct.pack(">H", len(x) + 2) + x for x in (body[i : i + 65000] for i in range(0, len(body), 65000)))
        scan = b"\xff\xda\0\x08\x01\x01\0\0\x3f\0"
        return b"\xff\xd8" + comments + scan + b"\x12\xff\0\xff\xd0\x34" + scan + b"\x56\xff\xd9"
    if kind == "bmp":
        row = body + b"\0" * (-len(body) % 4)
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(row), 0, 54, 40, len(row) // 4, 1, 1, 32, 0, len(row), 0, 0, 0, 0) + row
    head = b"\xff\xf8\x64\x02\0\x0f"
    frame = head + bytes([crc8(head)]) + b"\0\x07"
    info = struct.pack(">HH", 16, 16) + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    return b"fLaC\0\0\0\x22" + info + b"\x82" + len(body + b"text").to_bytes(3, "big") + b"text" + body + frame + struct.pack(">H", crc16(frame))


def identified(spark, sf_dir):
    """doc_id, declared, media_type, corrected, parts, carved_bytes: each document's text within a medium of one of the six formats, behind
    its own text as rubbish, all declared as wav, through identify(). Null texts are empty."""
    from pyspark.sql import functions as F

    from .common import documents

    kinds = list(VALID)

    def run(batches):
        for batch in batches:
            media = []
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                body = (t or "").encode()
                media.append(body[: 7 * (len(body) % 3)] + built(kinds[(d or 0) % 6], body))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(media, pa.binary())], ["doc_id", "content"])

    df = documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, content binary").withColumn("declared", F.lit("wav"))
    out = identify(df, "content", "declared", keep=["doc_id"])
    return out.select("doc_id", "declared", "media_type", "corrected", F.size("embedded").alias("parts"), F.expr("aggregate(embedded, 0L, (s, x) -> s + x.length)").alias("carved_bytes"))


def store(docs: DataFrame, unit: int = 192) -> DataFrame:
    """Each text as a padded 8-bit WAV, sniffed, carved and read back; one pass, no shuffle.

    Null text is empty; an empty one is stored as one unit of padding. Rows are
    independent, so repeated rows and any doc_id (null too) give equal values.
    """

    def run(batches):
        a = automaton()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = text.as_buffer() if text.is_valid else None
                raw = raw.to_pybytes() if raw is not None else b""
                payload = raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw))
                stored = wav(payload)
                (kind, at, n), *_ = sniff(stored, a)
                back = wav_samples(stored[at : at + n])
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{kind}:{at}:{n}:{sum(back) % 65521}"))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2(spark, sf_dir):
    """The columns of store() for all documents."""
    from .common import documents

    return store(documents(spark, sf_dir))


def payloads(spark, sf_dir):
    """doc_id, n_bytes, payload_bytes, payload_sha256 of op2: the part that SQL can check."""
    return op2(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = """
with d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) as n from documents)
select doc_id, n as n_bytes, greatest(1, (n + 191) // 192) * 192 as payload_bytes, sha256(text || repeat(' ', greatest(1, (n + 191) // 192) * 192 - n)) as payload_sha256 from d
"""
