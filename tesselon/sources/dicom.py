"""DICOM files: header fields and the text of a structured report, in the transfer syntaxes that don't compress data elements.

Explicit and implicit element types, either byte order, deflated data sets, nested sequences and items of known or unknown
length are read; pixels end the reading.  The report text is that of the items of the outermost content sequence, a line
each; without one, a line that names the study.  A file that breaks off inside an element raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

#: Tags of the header fields that are read.
FIELDS = {(0x0010, 0x0020): "patient_id", (0x0008, 0x0020): "study_date", (0x0008, 0x0060): "modality", (0x0008, 0x1030): "study_description", (0x0008, 0x103E): "series_description", (0x0018, 0x0015): "body_part", (0x0008, 0x0080): "institution"}
CHARACTERS, CONTENT, TEXT, PIXELS = (0x0008, 0x0005), (0x0040, 0xA730), (0x0040, 0xA160), (0x7FE0, 0x0010)
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
#: Element types whose length takes four bytes; transfer syntaxes.
LONG = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"))
IMPLICIT, DEFLATED, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
OPEN, DEEPEST = 0xFFFFFFFF, 100


class _Reader:
    def __init__(self, data: bytes, order: str = "<", explicit: bool = True):
        self.data, self.order, self.explicit = data, order, explicit

    def head(self, at: int, explicit: bool) -> tuple[tuple[int, int], bytes, int, int]:
        """tag, type, length and where the value begins."""
        tag = struct.unpack_from(f"{self.order}HH", self.data, at)
        if tag[0] == 0xFFFE or not explicit:
            return tag, b"", struct.unpack_from(f"{self.order}I", self.data, at + 4)[0], at + 8
        kind = self.data[at + 4 : at + 6]
        if kind in LONG:
            return tag, kind, struct.unpack_from(f"{self.order}I", self.data, at + 8)[0], at + 12
        return tag, kind, struct.unpack_from(f"{self.order}H", self.data, at + 6)[0], at + 8

    def data_set(self, at: int, end: int, explicit: bool, depth: int = 0) -> tuple[dict, int]:
        """Wanted elements up to ``end`` or the end of an item, and where reading stopped."""
        out: dict = {}
        while at + 8 <= end:
            tag, kind, size, value = self.head(at, explicit)
            if tag == ITEM_END:
                return out, value
            if tag == SEQUENCE_END or tag == PIXELS:
                return out, at if tag == SEQUENCE_END else end
            if size == OPEN or kind == b"SQ" or not kind and tag == CONTENT:
                known = explicit and kind != b"UN"  # a sequence of unknown type has implicit elements
                items, at = self.items(value, end if size == OPEN else value + size, known, depth + 1)
                if tag == CONTENT:
                    out[tag] = items
                continue
            at = value + size
            if at > len(self.data):
                raise ValueError("an element goes beyond the end of the file")
            if tag in FIELDS or tag in (CHARACTERS, TEXT):
                out[tag] = self.data[value:at]
        return out, at

    def items(self, at: int, end: int, explicit: bool, depth: int) -> tuple[list[dict], int]:
        if depth > DEEPEST:
            raise ValueError("sequences are nested too deeply")
        out = []
        while at + 8 <= end:
            tag, _, size, value = self.head(at, explicit)
            if tag == SEQUENCE_END:
                return out, value
            if tag != ITEM:
                raise ValueError("an item is missing in a sequence")
            one, at = self.data_set(value, end if size == OPEN else value + size, explicit, depth)
            out.append(one)
        return out, at


def read(content: bytes) -> tuple[dict[str, str], str]:
    """Header fields and report text of a file."""
    if content[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    r, at, syntax = _Reader(content), 132, ""
    try:
        while at + 8 <= len(content) and struct.unpack_from("<H", content, at)[0] == 2:
            tag, _, size, value = r.head(at, True)
            at = value + size
            if tag == (0x0002, 0x0010):
                syntax = content[value:at].decode("ascii", "replace").rstrip("\0 ")
        data = zlib.decompress(content[at:], -15) if syntax == DEFLATED else content[at:]
        explicit = syntax != IMPLICIT
        found, _ = _Reader(data, ">" if syntax == BIG else "<").data_set(0, len(data), explicit)
    except (struct.error, zlib.error) as e:
        raise ValueError(f"a broken DICOM file: {e}") from e
    coding = "utf-8" if b"192" in found.get(CHARACTERS, b"") else "latin-1"
    told = lambda raw: raw.decode(coding, "replace").rstrip("\0 ")
    header = {name: told(found[tag]) for tag, name in FIELDS.items() if tag in found}
    lines = [told(x[TEXT]) for x in found.get(CONTENT, []) if TEXT in x]
    text = "".join(f"{x}\n" for x in lines)
    return header, text or f"[DICOM study: {header.get('study_description', '')}]"


# ---------------------------------------------------------------- writing


def _element(order: str, explicit: bool, tag: tuple[int, int], kind: bytes, value: bytes, open_end: bool = False) -> bytes:
    value = value + (b"" if len(value) % 2 == 0 else b" ")
    size = OPEN if open_end else len(value)
    tail = struct.pack(f"{order}HHI", *SEQUENCE_END, 0) if open_end else b""
    if not explicit:
        return struct.pack(f"{order}HHI", *tag, size) + value + tail
    if kind in LONG:
        return struct.pack(f"{order}HH", *tag) + kind + b"\0\0" + struct.pack(f"{order}I", size) + value + tail
    return struct.pack(f"{order}HH", *tag) + kind + struct.pack(f"{order}H", size) + value


def report(header: dict[str, str], lines: list[str] | None, syntax: str, open_end: bool = False) -> bytes:
    """A file with these header fields and a content sequence of these lines, each with a nested item of its own; None: no sequence."""
    order, explicit = ">" if syntax == BIG else "<", syntax != IMPLICIT
    put = lambda tag, kind, value, end=False: _element(order, explicit, tag, kind, value, end)

    def item(body: bytes) -> bytes:
        head = struct.pack(f"{order}HHI", *ITEM, OPEN if open_end else len(body))
        return head + body + (struct.pack(f"{order}HHI", *ITEM_END, 0) if open_end else b"")

    tags = {name: tag for tag, name in FIELDS.items()}
    body = {CHARACTERS: put(CHARACTERS, b"CS", b"ISO_IR 192"), **{tags[n]: put(tags[n], b"LO", v.encode()) for n, v in header.items()}}
    if lines is not None:
        inner = put(CONTENT, b"SQ", item(put(TEXT, b"UT", b"nested")), open_end)
        body[CONTENT] = put(CONTENT, b"SQ", b"".join(item(put(TEXT, b"UT", x.encode()) + inner) for x in lines), open_end)
    data = b"".join(body[t] for t in sorted(body))
    if syntax == DEFLATED:
        deflate = zlib.compressobj(wbits=-15)
        data = deflate.compress(data) + deflate.flush()
    name = syntax.encode() + b"\0" * (len(syntax) % 2)
    meta = struct.pack("<HH", 2, 0x10) + b"UI" + struct.pack("<H", len(name)) + name
    return bytes(128) + b"DICM" + meta + data
