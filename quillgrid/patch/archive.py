"""Copies of ZIP archives in which untouched members keep their compressed bytes."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

from ..errors import EngineError

_LOCAL = struct.Struct("<4s5H3L2H")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_LIMIT = 0xFFFFFFFF


def _record(f, info: zipfile.ZipInfo) -> tuple[bytes, int]:
    """The local header of a member without its data, and where the data start."""
    f.seek(info.header_offset)
    head = f.read(_LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
        raise EngineError(f"damaged record of {info.filename!r}")
    names, extra = _LOCAL.unpack(head)[-2:]
    return head + f.read(names + extra), info.header_offset + _LOCAL.size + names + extra


def _wide(*values: int) -> bytes:
    """An extra field with 64-bit values."""
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""


def _other_extra(extra: bytes) -> bytes:
    """Extra fields but the one for 64-bit values."""
    out, at = b"", 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind != 1:
            out += extra[at : at + 4 + size]
        at += 4 + size
    return out + extra[at:]


def copy(source: str, target, replaced: dict[str, bytes], dropped: set[str] = frozenset()) -> dict[str, dict]:
    """Write source to the open file target with some members replaced or left out.

    Members that stay are copied record by record: compressed bytes, times and attributes are those of the
    source. Returns for each of them the digest of its compressed bytes.
    """
    told: dict[str, dict] = {}
    central: list[bytes] = []
    with open(source, "rb") as f, zipfile.ZipFile(f) as z:
        infos = sorted(z.infolist(), key=lambda i: i.header_offset)
        for name in [*replaced, *dropped]:
            if name not in z.NameToInfo:
                raise EngineError(f"the package has no part {name!r}")
        for info in infos:
            if info.filename in dropped:
                continue
            at = target.tell()
            name = info.filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437")
            year, month, day, hour, minute, second = info.date_time
            date, time = (year - 1980) << 9 | month << 5 | day, hour << 11 | minute << 5 | second // 2
            method, flags, crc, size, packed_size = info.compress_type, info.flag_bits, info.CRC, info.file_size, info.compress_size
            if info.filename in replaced:
                data = replaced[info.filename]
                packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                packed = packer.compress(data) + packer.flush()
                method, crc, size, packed_size, flags = zipfile.ZIP_DEFLATED, zlib.crc32(data), len(data), len(packed), flags & 0x800
                large = max(size, packed_size) >= _LIMIT
                extra = _wide(size, packed_size) if large else b""
                target.write(_LOCAL.pack(b"PK\x03\x04", 45 if large else 20, flags, method, time, date, crc, _LIMIT if large else packed_size, _LIMIT if large else size, len(name), len(extra)) + name + extra + packed)
            else:
                head, start = _record(f, info)
                target.write(head)
                f.seek(start)
                left, digest = packed_size, hashlib.sha256()
                while left:
                    chunk = f.read(min(left, 1 << 20))
                    if not chunk:
                        raise EngineError(f"damaged record of {info.filename!r}")
                    digest.update(chunk)
                    target.write(chunk)
                    left -= len(chunk)
                if flags & 8:  # the sizes follow the data
                    nxt = f.read(4)
                    wide = any(struct.unpack_from("<H", e)[0] == 1 for e in [head[-struct.unpack_from("<H", head, 28)[0] :]] if struct.unpack_from("<H", head, 28)[0] >= 4)
                    rest = f.read((20 if wide else 12) - (0 if nxt == b"PK\x07\x08" else 4))
                    target.write(nxt + rest)
                told[info.filename] = {"sha256": digest.hexdigest(), "bytes": packed_size}
            wide = [v for v in (size, packed_size, at) if v >= _LIMIT]
            extra = _wide(*wide) + _other_extra(info.extra)
            cap = lambda v: min(v, _LIMIT)
            central.append(_CENTRAL.pack(b"PK\x01\x02", info.create_version | info.create_system << 8, max(info.extract_version, 45 if wide else 20), flags, method, time, date, crc, cap(packed_size), cap(size), len(name), len(extra), len(info.comment), 0, info.internal_attr, info.external_attr, cap(at)) + name + extra + info.comment)
        begins = target.tell()
        target.write(b"".join(central))
        size, n = target.tell() - begins, len(central)
        if n >= 0xFFFF or begins >= _LIMIT or size >= _LIMIT:
            end = target.tell()
            target.write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, begins))
            target.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
        target.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _LIMIT), min(begins, _LIMIT), len(z.comment)) + z.comment)
    return told
