"""Text out of the bytes of office files; also the program of the process that reads them apart. Standard library only."""

from __future__ import annotations

import io
import json
import re
import struct
import sys
import xml.parsers.expat
import zipfile
import zlib
from collections.abc import Iterator

# The file formats, the bytes searched for PDF's encryption mark.
FORMATS = ["pdf", "docx", "xlsx", "pptx", "txt", "md", "csv", "json", "log", "rst"]
PDF_TAIL, PDF_MARK = 128 * 1024, b"/Encrypt"
LINE_ENDS = {"p", "tr", "row"}
OFFICE = {"pdf", "docx", "xlsx", "pptx"}


def decode_bytes(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8 if valid, else GB18030; what cannot be decoded is replaced."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data.startswith(b"\xff\xfe"):
        return data[2:].decode("utf-16-le", "replace")
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def markup_text(xml_source: str | bytes) -> str:
    """The text of XML: its pieces trimmed and joined by spaces, a new line after each paragraph, row or table row.

    Tags are compared with their prefix, so only unprefixed ones end a line; CDATA is passed over.
    """
    out: list[str] = []
    piece: list[str] = []
    state = {"cdata": False}

    def flush() -> None:
        value = "".join(piece).strip()
        piece.clear()
        if value:
            if out:
                out.append(" ")
            out.append(value)

    def end(name: str) -> None:
        flush()
        if name in LINE_ENDS:
            out.append("\n")

    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    parser.CharacterDataHandler = lambda data: None if state["cdata"] else piece.append(data)
    parser.StartElementHandler = lambda *_: flush()
    parser.EndElementHandler = end
    parser.CommentHandler = lambda _: flush()
    parser.ProcessingInstructionHandler = lambda *_: flush()
    parser.StartCdataSectionHandler = lambda: (flush(), state.update(cdata=True))
    parser.EndCdataSectionHandler = lambda: state.update(cdata=False)
    parser.Parse(xml_source, True)
    return "".join(out)


def _digits(name: str) -> int:
    number = "".join(c for c in name if c in "0123456789")
    return int(number) if number and int(number) < 1 << 64 else 0


def _is_part(name: str, kind: str) -> bool:
    if kind == "docx":
        return name == "word/document.xml"
    if kind == "pptx":
        return name.startswith("ppt/slides/slide") and name.endswith(".xml")
    return name == "xl/sharedStrings.xml" or (name.startswith("xl/worksheets/sheet") and name.endswith(".xml"))


def office_text(data: bytes, kind: str) -> str:
    """The text of a Word, PowerPoint or Excel file: its parts in the order of the numbers in their names."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise ValueError("invalid zip archive") from error
    out = []
    with archive:
        for name in sorted((n for n in archive.namelist() if _is_part(n, kind)), key=_digits):
            found = markup_text(archive.read(name))
            if found:
                out.append(found + "\n")
    return "".join(out)


# -- PDF -----------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|\Z)", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+\d?", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_CONTROL = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        code = m[1]
        return bytes([int(code, 8) & 255]) if code[:1].isdigit() and code[:1] < b"8" else _CONTROL.get(code, code)

    return _ESCAPE.sub(plain, token[1:-1])


def _streams(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body[: found.start()] else found[1]


def _code_map(cmap: bytes) -> dict[bytes, str]:
    """Codes and their characters from a font's table of them."""
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            first, last, width = int(low, 16), int(high, 16), len(low) // 2
            each = [text(t) for t in re.findall(rb"<([0-9A-Fa-f]+)>", several)]
            for i in range(min(last - first + 1, 65_536)):
                start = text(to) if to else ""
                value = each[i] if i < len(each) else start[:-1] + chr(ord(start[-1]) + i) if start else ""
                out[(first + i).to_bytes(width, "big")] = value
    return out


def _pdf_objects(data: bytes) -> dict[int, bytes]:
    """The file's objects by number, those inside object streams as well."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        first, count = re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
        if b"/ObjStm" in body and first and count:
            packed = _streams(body)
            heads = [int(x) for x in packed[: int(first[1])].split()[: 2 * int(count[1])]]
            starts = [*heads[1::2], len(packed) - int(first[1])]
            for number, a, b in zip(heads[::2], starts, starts[1:], strict=False):
                found.setdefault(number, packed[int(first[1]) + a : int(first[1]) + b])
    return found


def _referred(body: bytes, name: bytes) -> list[int]:
    found = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


def _shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> Iterator[str]:
    """The pieces of text that a page's content shows, and line ends where it moves to another line."""
    codes: dict[bytes, str] = {}
    waiting: list[bytes] = []

    def read(raw: bytes) -> str:
        if not codes:
            return raw.decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "cp1252", "replace")
        width = len(next(iter(codes)))
        return "".join(codes.get(raw[i : i + width], "") for i in range(0, len(raw), width))

    for m in _SHOW.finditer(content):
        token = m[0]
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                yield "\n"
            for part in waiting:
                if part[:1] in b"(<":
                    yield read(_literal(part))
                elif token == b"TJ" and re.fullmatch(rb"-\d{3,}(\.\d*)?", part):  # a wide gap between words
                    yield " "
            waiting = []
        elif token == b"Tf":
            names = [w for w in waiting if w[:1] == b"/"]
            codes = fonts.get(names[-1][1:], {}) if names else {}
            waiting = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            moved = token in (b"T*", b"ET", b"Tm") or len(waiting) > 1 and waiting[-1].strip(b"-+0.") != b""
            yield "\n" if moved else " "
            waiting = []
        elif token[:1].isalpha():
            waiting = []
        else:
            waiting.append(token)


def plain_pdf_text(data: bytes) -> str:
    """The text of a PDF whose content is stored as it is or deflated, page by page in the order of the page tree."""
    if not data.lstrip()[:5].startswith(b"%PDF-"):
        raise ValueError("invalid PDF")
    objects = _pdf_objects(data)
    maps: dict[int, dict[bytes, str]] = {}

    def fonts_of(body: bytes) -> dict[bytes, dict[bytes, str]]:
        held = b"".join([body, *[objects.get(n, b"") for n in _referred(body, b"Resources")]])
        place = held.find(b"/Font")
        listed = b"".join([held[place:], *[objects.get(n, b"") for n in _referred(held, b"Font")]])
        out = {}
        for name, number in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", listed):
            for n in _referred(objects.get(int(number), b""), b"ToUnicode"):
                if n not in maps:
                    maps[n] = _code_map(_streams(objects.get(n, b"")))
                out[name] = maps[n]
        return out

    def pages(number: int, above: bytes, seen: set[int]) -> Iterator[tuple[bytes, bytes]]:
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        if kids := _referred(body, b"Kids"):
            for kid in kids:
                yield from pages(kid, body, seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body, above

    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not re.search(rb"/Parent\b", body)]
    seen: set[int] = set()
    out = []
    for root in roots:
        for body, above in pages(root, b"", seen):
            fonts = fonts_of(above) | fonts_of(body)
            out += ["".join(_shown(_streams(objects.get(n, b"")), fonts)) for n in _referred(body, b"Contents")]
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """The text of a PDF, by pypdf where it is installed, else of its plain and deflated contents; encrypted ones are refused."""
    if PDF_MARK in data[-PDF_TAIL:]:
        raise ValueError("document is encrypted")
    try:
        from pypdf import PdfReader
    except ImportError:
        return plain_pdf_text(data)
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


# -- all ------------------------------------------------------------------------------------------------------------


def plain_lines(value: str) -> str:
    """The same normal form as the column function of that purpose."""
    return "\n".join(line for line in (" ".join(x.split()) for x in value.split("\n")) if line)


def extract_text(data: bytes, extension: str) -> str:
    """The normalised text of a file; an error if there is none."""
    kind = extension.lower()
    if kind == "pdf":
        value = pdf_text(data)
    elif kind in OFFICE:
        value = office_text(data, kind)
    elif kind in FORMATS:
        value = decode_bytes(data)
    else:
        raise ValueError(f"unsupported format: {extension}")
    value = plain_lines(value)
    if not value:
        raise ValueError("no text was found")
    return value


def serve() -> None:
    """Answer requests on standard input: the length of the extension and of the data, then both; the answer is JSON."""
    source, sink = sys.stdin.buffer, sys.stdout.buffer
    while len(head := source.read(12)) == 12:
        name, size = struct.unpack("<IQ", head)
        extension = source.read(name).decode()
        data = source.read(size)
        try:
            answer = [extract_text(data, extension), None]
        except Exception as error:  # noqa: BLE001
            answer = [None, str(error) or type(error).__name__]
        raw = json.dumps(answer).encode()
        sink.write(struct.pack("<Q", len(raw)) + raw)
        sink.flush()


if __name__ == "__main__":
    serve()
