"""ZIP members and gzip files, checked and bounded."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from .xmlevents import decode_utf8

MAX_MEMBER = 64 << 20


class ArchiveError(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    csize: int
    usize: int
    offset: int
    crc: int


def _small(*sizes: int) -> None:
    if any(s >= 1 << 31 for s in sizes):
        raise ArchiveError("size field exceeds 31 bits")


def members(data: bytes) -> list[Member]:
    """The central directory in its order."""
    n = len(data)
    if n < 22:
        raise ArchiveError("not a zip archive (too small)")
    end = data.rfind(b"PK\x05\x06")
    while end >= max(0, n - 22 - 0xFFFF):
        if end + 22 <= n and end + 22 + struct.unpack_from("<H", data, end + 20)[0] == n:
            break
        end = data.rfind(b"PK\x05\x06", 0, end + 3)
    else:
        raise ArchiveError("not a zip archive (no end-of-central-directory)")
    disk, start_disk, _, count, size, at = struct.unpack_from("<HHHHII", data, end + 4)
    if disk or start_disk:
        raise ArchiveError("multi-disk zip not supported")
    if count == 0xFFFF:
        raise ArchiveError("zip64 not supported")
    _small(at, size)
    if at + size > n:
        raise ArchiveError("central directory out of bounds")
    out = []
    for _ in range(count):
        if at + 46 > n:
            raise ArchiveError("truncated central directory")
        if data[at : at + 4] != b"PK\x01\x02":
            raise ArchiveError("bad central directory entry")
        flags, method, crc, csize, usize, name, extra, comment, offset = struct.unpack_from("<8xHH4xIIIHHH8xI", data, at)
        _small(csize, usize, offset)
        if at + 46 + name > n:
            raise ArchiveError("truncated central directory")
        out.append(Member(decode_utf8(data[at + 46 : at + 46 + name]), method, flags, csize, usize, offset, crc))
        at += 46 + name + extra + comment
    return out


def find(found: list[Member], name: str) -> Member | None:
    return next((m for m in found if m.name == name), None)


def inflate(raw: bytes, size: int) -> bytes:
    """A raw deflate stream that must give exactly size bytes."""
    if size <= 0:
        return b""
    stream = zlib.decompressobj(-15)
    try:
        out = stream.decompress(raw, size + 1)
    except zlib.error as e:
        raise ArchiveError("corrupt deflate data") from e
    if len(out) > size:
        raise ArchiveError("deflate stream does not fit its declared size")
    if not stream.eof:
        raise ArchiveError("truncated deflate stream")
    if len(out) != size:
        raise ArchiveError("deflate stream does not fit its declared size")
    return out


def extract(data: bytes, member: Member) -> bytes:
    if member.flags & 1:
        raise ArchiveError("member is encrypted")
    if member.usize > MAX_MEMBER:
        raise ArchiveError(f"member larger than the {MAX_MEMBER >> 20}MB cap")
    if member.offset + 30 > len(data):
        raise ArchiveError("local header out of bounds")
    if data[member.offset : member.offset + 4] != b"PK\x03\x04":
        raise ArchiveError("bad local header")
    start = member.offset + 30 + sum(struct.unpack_from("<HH", data, member.offset + 26))
    raw = data[start : start + member.csize]
    if start + member.csize > len(data):
        raise ArchiveError("member data out of bounds")
    if member.method == 0:
        if member.csize != member.usize:
            raise ArchiveError("stored member with mismatched sizes")
    elif member.method == 8:
        raw = inflate(raw, member.usize)
    else:
        raise ArchiveError(f"unsupported compression method {member.method} (only stored and deflated)")
    if zlib.crc32(raw) != member.crc:
        raise ArchiveError("CRC mismatch (corrupt member)")
    return raw


def listing(data: bytes) -> str:
    """One line for each member: size, method, name."""
    names = {0: "stored", 8: "deflate"}
    return "".join(f"{m.usize:>9}  {names.get(m.method, f'method {m.method}'):<9}{m.name}\n" for m in members(data))


def gunzip(data: bytes) -> bytes:
    """The one member of a gzip file, by its stated size."""
    n = len(data)
    if n < 18:
        raise ArchiveError("truncated gzip file")
    if data[:2] != b"\x1f\x8b":
        raise ArchiveError("not a gzip file")
    if data[2] != 8:
        raise ArchiveError("unsupported gzip compression method")
    flags, at = data[3], 10
    if flags >= 0x20:
        raise ArchiveError("bad gzip flags (reserved bits set)")
    if flags & 4:
        at = at + 2 + struct.unpack_from("<H", data, at)[0] if at + 2 <= n else n + 1
    for bit in (8, 16):
        if flags & bit and at <= n:
            at = data.find(b"\0", at) + 1 or n + 1
    if flags & 2:
        at += 2
    if at > n:
        raise ArchiveError("truncated gzip header")
    if at > n - 8:
        raise ArchiveError("truncated gzip file")
    crc, size = struct.unpack_from("<II", data, n - 8)
    if size >= 1 << 31:
        raise ArchiveError("gzip size field: size field exceeds 31 bits")
    out = inflate(data[at : n - 8], size)
    if zlib.crc32(out) != crc:
        raise ArchiveError("CRC mismatch (corrupt gzip data)")
    return out
