"""PDF files of text: a writer of placed lines, and a reader of pages, text and metadata.

The reader finds objects by scanning, so a file with a damaged cross-reference
table can still be read. It knows FlateDecode streams, object streams, RC4 and
AES encryption of revisions 2 to 6, and text shown in simple fonts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quire.formats import crypto
from quire.operators.layout import text_width

INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")


class Unreadable(ValueError):
    """Why a file cannot be opened: password, corrupt."""


def _text(value: str) -> bytes:
    body = value.encode("cp1252", "replace")
    for a in (b"\\", b"(", b")"):
        body = body.replace(a, b"\\" + a)
    return b"(" + body + b")"


@dataclass
class Placed:
    text: str
    x: float
    y: float
    size: float = 11.0
    degrees: float = 0.0


@dataclass
class Page:
    lines: list[Placed] = field(default_factory=list)
    drawn: list[bytes] = field(default_factory=list)  # operators of paths, as they stand
    width: float = 612.0
    height: float = 792.0
    rotation: int = 0


def write(pages: list[Page], info: dict[str, str] | None = None, password: str | None = None, owner: str | None = None) -> bytes:
    """A file of the pages in Helvetica; with a password its strings and streams are enciphered with 128-bit RC4."""
    import math

    first, count = 4, len(pages)
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(count))
    objects: dict[int, list] = {
        1: [b"<< /Type /Catalog /Pages 2 0 R >>"],
        2: [f"<< /Type /Pages /Count {count} /Kids [{kids}] >>".encode()],
        3: [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"],
    }
    for i, p in enumerate(pages):
        ops = list(p.drawn)
        for t in p.lines:
            c, s = math.cos(math.radians(t.degrees)), math.sin(math.radians(t.degrees))
            ops.append(b"BT /F1 %g Tf %.4f %.4f %.4f %.4f %.2f %.2f Tm " % (t.size, c, s, -s, c, t.x, t.y) + _text(t.text) + b" Tj ET")
        objects[first + 2 * i] = [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {p.width:g} {p.height:g}] /Rotate {p.rotation} /Resources << /Font << /F1 3 0 R >> >> /Contents {first + 2 * i + 1} 0 R >>".encode()]
        objects[first + 2 * i + 1] = [b"", zlib.compress(b"\n".join(ops))]
    last = first + 2 * count
    e = None
    if password is not None:
        e = crypto.Encryption(3, 16, b"", b"", -44, b"0123456789abcdef")
        e.owner = crypto.early_owner((owner or password).encode("latin-1", "replace"), password.encode("latin-1", "replace"), e)
        key = crypto.early_key(password.encode("latin-1", "replace"), e)
        e.user = crypto.early_user(key, e) + bytes(16)
        for n, body in objects.items():
            if len(body) > 1:
                body[1] = crypto.rc4(crypto.object_key(key, n, 0, False), body[1])
        hexed = lambda b: b"<" + b.hex().encode() + b">"
        objects[last + 1] = [b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P %d /O %s /U %s >>" % (e.permissions, hexed(e.owner), hexed(e.user))]
    told = {k: v for k, v in (info or {}).items() if k in INFO}
    strings = {k: (b"<" + crypto.rc4(crypto.object_key(key, last, 0, False), v.encode("cp1252", "replace")).hex().encode() + b">") if e else _text(v) for k, v in told.items()}
    objects[last] = [b"<< " + b" ".join(b"/" + k.encode() + b" " + v for k, v in strings.items()) + b" >>"]
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n in sorted(objects):
        at[n] = len(out)
        head, *stream = objects[n]
        out += b"%d 0 obj\n" % n
        out += b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(stream[0]) + stream[0] + b"\nendstream" if stream else head
        out += b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (max(at) + 1) + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, max(at) + 1))
    secret = b" /Encrypt %d 0 R /ID [%s %s]" % (last + 1, hexed(e.file_id), hexed(e.file_id)) if e else b""
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (max(at) + 1, last, secret, start))


_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(<<|>>|\[|\]|\{|\})|/([^\s()<>\[\]{}/%]*)|<([0-9A-Fa-f\s]*)>|(\()|([^\s()<>\[\]{}/%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(tuple):
    pass


class Word(bytes):
    """An operator or keyword."""


def tokens(data: bytes, at: int = 0):
    """Values of a content stream or object: numbers, names, strings as bytes, marks and words."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m[1]:
            yield Word(m[1])
        elif m[2] is not None and m[0][:1] == b"/":
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[2]).decode("latin-1"))
        elif m[3] is not None:
            digits = re.sub(rb"\s", b"", m[3])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m[4]:
            depth, out = 1, bytearray()
            while at < len(data) and depth:
                c = data[at : at + 1]
                at += 1
                if c == b"\\":
                    o = re.compile(rb"[0-7]{1,3}").match(data, at)
                    if o:
                        out.append(int(o[0], 8) & 255)
                        at = o.end()
                        continue
                    c = data[at : at + 1]
                    at += 1
                    out += _ESCAPES.get(c, b"" if c in b"\r\n" else c)
                    continue
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
            yield bytes(out)
        elif m[5]:
            try:
                yield float(m[5]) if b"." in m[5] else int(m[5])
            except ValueError:
                yield Word(m[5])


def parse(data: bytes):
    """The value that an object's text begins with."""
    stack: list = [[]]
    for t in tokens(data):
        if t in (b"<<", b"[") and isinstance(t, Word):
            stack.append([])
        elif t in (b">>", b"]") and isinstance(t, Word) and len(stack) > 1:
            items = stack.pop()
            stack[-1].append(items if t == b"]" else {items[i]: items[i + 1] for i in range(0, len(items) - 1, 2) if isinstance(items[i], Name)})
        elif t == b"R" and isinstance(t, Word) and len(stack[-1]) > 1:
            g, n = stack[-1].pop(), stack[-1].pop()
            stack[-1].append(Ref((n, g)))
        elif isinstance(t, Word) and t in (b"stream", b"endobj"):
            break
        else:
            stack[-1].append({b"true": True, b"false": False, b"null": None}.get(t, t) if isinstance(t, Word) else t)
    return stack[0][0] if stack[0] else None


class File:
    def __init__(self, data: bytes, password: str = ""):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("corrupt: no PDF begins here")
        self.data, self.objects, self.key, self.aes = data, {}, None, False
        self.where = {int(m[1]): m.end() for m in re.finditer(rb"(?:^|[\r\n\s])(\d+)\s+\d+\s+obj\b", data)}
        trailers = [parse(data[m.end() :]) for m in re.finditer(rb"trailer\b", data)]
        for n in list(self.where):
            d = self.get(n)
            if isinstance(d, dict) and d.get("Type") == "XRef":
                trailers.append(d)
        self.trailer: dict = {}
        for t in trailers:
            if isinstance(t, dict):
                self.trailer |= {k: v for k, v in t.items() if v is not None}
        if self.trailer.get("Encrypt") is not None:
            self._unlock(self.of(self.trailer["Encrypt"]), password.encode("latin-1", "replace"))
        for n in list(self.where):
            d = self.get(n)
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                self._packed(n, d)
        self.root = self.of(self.trailer.get("Root")) or next((o for o in map(self.get, self.where) if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(self.root, dict):
            raise Unreadable("corrupt: the catalog is missing")

    def _unlock(self, d: dict, password: bytes) -> None:
        filters = self.of((d.get("CF") or {}).get(d.get("StmF", "StdCF"))) or {}
        self.aes = filters.get("CFM") in ("AESV2", "AESV3")
        size = 5 if d.get("R") == 2 else (16 if d.get("V", 1) == 4 else d.get("Length", 40) // 8)
        e = crypto.Encryption(d["R"], size, d["O"], d["U"], d["P"], (self.trailer.get("ID") or [b""])[0], d.get("OE", b""), d.get("UE", b""), d.get("EncryptMetadata", True))
        try:
            self.key, self.revision = crypto.file_key(password, e), d["R"]
        except crypto.WrongPassword as wrong:
            raise Unreadable("password: it does not open this file") from wrong

    def plain(self, n: int, data: bytes) -> bytes:
        """An object's string or stream without its encryption."""
        if self.key is None:
            return data
        key = self.key if self.revision >= 5 else crypto.object_key(self.key, n, 0, self.aes)
        return crypto.cbc_decrypt(key, data[:16], data[16 : len(data) - len(data) % 16]) if self.aes else crypto.rc4(key, data)

    def get(self, n: int):
        if n not in self.objects and n in self.where:
            end = self.data.find(b"endobj", self.where[n])
            self.objects[n] = parse(self.data[self.where[n] : end if end > 0 else None])
        return self.objects.get(n)

    def of(self, value):
        """The value itself, a reference followed."""
        seen = 0
        while isinstance(value, Ref) and seen < 20:
            value, seen = self.get(value[0]), seen + 1
        return value

    def stream(self, n: int) -> bytes:
        d, at = self.get(n), self.data.find(b"stream", self.where[n])
        at += 8 if self.data[at + 6 : at + 8] == b"\r\n" else 7
        size = self.of(d.get("Length"))
        end = at + size if isinstance(size, int) and self.data[at + size : at + size + 12].strip().startswith(b"endstream") else self.data.find(b"endstream", at)
        body = self.data[at:end]
        body = self.plain(n, body) if d.get("Type") != "XRef" else body
        filters = self.of(d.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f == "FlateDecode":
                body = zlib.decompressobj().decompress(body)
            elif f == "ASCIIHexDecode":
                body = bytes.fromhex(re.sub(rb"[\s>]", b"", body).decode())
            else:
                raise Unreadable(f"failed: filter {f}")
        return body

    def _packed(self, n: int, d: dict) -> None:
        body, first = self.stream(n), d["First"]
        numbers = [t for t in tokens(body[:first]) if isinstance(t, int)]
        for k in range(0, len(numbers) - 1, 2):
            self.objects.setdefault(numbers[k], parse(body[first + numbers[k + 1] :]))

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out: list[dict] = []

        def walk(node, above: dict, depth: int) -> None:
            node = self.of(node)
            if not isinstance(node, dict) or depth > 50:
                return
            own = above | {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for k in self.of(node.get("Kids")) or []:
                    walk(k, own, depth + 1)
            else:
                out.append(node | own)

        walk(self.root.get("Pages"), {}, 0)
        return out

    def content(self, page: dict) -> bytes:
        refs = page.get("Contents")
        refs = refs if isinstance(refs, Ref) and not isinstance(self.of(refs), list) else self.of(refs)
        return b"\n".join(self.stream(r[0]) for r in (refs if isinstance(refs, list) and not isinstance(refs, Ref) else [refs]) if isinstance(r, Ref))

    def items(self, page: dict) -> list[dict]:
        """Text shown on a page: text, x, y, size, width."""
        out, stack, args = [], [], []
        text, line, size, leading, ctm = (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0), 1.0, 0.0, (1, 0, 0, 1, 0, 0)

        def times(a, b):
            return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])

        def show(raw: bytes) -> None:
            nonlocal text
            s = raw.decode("cp1252", "replace")
            at, wide = times(text, ctm), text_width(s, size)
            out.append({"text": s, "x": at[4], "y": at[5], "size": size * abs(at[3] or at[0] or 1), "width": wide * abs(at[0] or 1)})
            text = times((1, 0, 0, 1, wide, 0), text)

        for t in tokens(self.content(page)):
            if not isinstance(t, Word) or t in (b"[", b"]", b"<<", b">>"):
                args.append(t)
                continue
            numbers = [a for a in args if isinstance(a, (int, float))]
            if t == b"q":
                stack.append(ctm)
            elif t == b"Q" and stack:
                ctm = stack.pop()
            elif t == b"cm" and len(numbers) == 6:
                ctm = times(tuple(numbers), ctm)
            elif t == b"BT":
                text = line = (1, 0, 0, 1, 0, 0)
            elif t == b"Tf" and numbers:
                size = numbers[-1]
            elif t == b"TL" and numbers:
                leading = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) == 2:
                leading = -numbers[1] if t == b"TD" else leading
                text = line = times((1, 0, 0, 1, *numbers), line)
            elif t == b"Tm" and len(numbers) == 6:
                text = line = tuple(numbers)
            elif t in (b"T*", b"'", b'"'):
                text = line = times((1, 0, 0, 1, 0, -leading), line)
            if t in (b"Tj", b"'", b'"', b"TJ"):
                for a in args:
                    if isinstance(a, bytes) and not isinstance(a, Word):
                        show(a)
                    elif t == b"TJ" and isinstance(a, (int, float)):
                        text = times((1, 0, 0, 1, -a * size / 1000, 0), text)
            args = []
        return out

    def marks(self, page: dict) -> tuple[list[tuple], list[tuple]]:
        """What is drawn with straight lines on a page.

        Rules (horizontal, pos, start, end, thickness, colour): stroked upright or
        level lines, and filled boxes no thicker than 2. Fills (x0, y0, x1, y1,
        colour): other filled boxes. Colours are RRGGBB.
        """
        rules, fills, saved, args = [], [], [], []
        ctm, width, stroke, fill = (1, 0, 0, 1, 0, 0), 1.0, "000000", "000000"
        path: list[tuple] = []  # lines and boxes, both as x0, y0, x1, y1 with their kind
        at = start = (0.0, 0.0)

        def point(x: float, y: float) -> tuple[float, float]:
            return ctm[0] * x + ctm[2] * y + ctm[4], ctm[1] * x + ctm[3] * y + ctm[5]

        def paint(stroked: bool, filled: bool) -> None:
            for kind, x0, y0, x1, y1 in path:
                x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
                if kind == "box" and filled:
                    thin = min(x1 - x0, y1 - y0)
                    if thin > 2:
                        fills.append((x0, y0, x1, y1, fill))
                    elif y1 - y0 <= x1 - x0:
                        rules.append((True, (y0 + y1) / 2, x0, x1, thin, fill))
                    else:
                        rules.append((False, (x0 + x1) / 2, y0, y1, thin, fill))
                if stroked:
                    sides = [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)] if kind == "box" else [(x0, y0, x1, y1)]
                    for a, b, c, d in sides:
                        if abs(d - b) <= 0.5 < abs(c - a):
                            rules.append((True, b, a, c, width, stroke))
                        elif abs(c - a) <= 0.5 < abs(d - b):
                            rules.append((False, a, b, d, width, stroke))

        for t in tokens(self.content(page)):
            if not isinstance(t, Word):
                args.append(t)
                continue
            n = [float(a) for a in args if isinstance(a, (int, float))]
            args = []
            if t == b"q":
                saved.append((ctm, width, stroke, fill))
            elif t == b"Q" and saved:
                ctm, width, stroke, fill = saved.pop()
            elif t == b"cm" and len(n) == 6:
                ctm = (n[0] * ctm[0] + n[1] * ctm[2], n[0] * ctm[1] + n[1] * ctm[3], n[2] * ctm[0] + n[3] * ctm[2], n[2] * ctm[1] + n[3] * ctm[3], n[4] * ctm[0] + n[5] * ctm[2] + ctm[4], n[4] * ctm[1] + n[5] * ctm[3] + ctm[5])
            elif t == b"w" and n:
                width = n[0]
            elif t in (b"RG", b"G", b"K"):
                stroke = color(n)
            elif t in (b"rg", b"g", b"k"):
                fill = color(n)
            elif t == b"m" and len(n) == 2:
                at = start = point(*n)
            elif t == b"l" and len(n) == 2:
                end = point(*n)
                path.append(("line", *at, *end))
                at = end
            elif t in (b"c", b"v", b"y") and len(n) > 3:
                at = point(*n[-2:])
            elif t == b"h":
                path.append(("line", *at, *start))
                at = start
            elif t == b"re" and len(n) == 4:
                path.append(("box", *point(n[0], n[1]), *point(n[0] + n[2], n[1] + n[3])))
            elif t in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                paint(t in (b"S", b"s", b"B", b"B*", b"b", b"b*"), t in (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"))
                path = []
        return rules, fills

    def images(self, page: dict) -> list[tuple[str, int, int, str]]:
        """(name, width, height, filter) of the pictures that a page may draw, each once."""
        found = self.of((self.of(page.get("Resources")) or {}).get("XObject")) or {}
        out = []
        for name, ref in found.items():
            d = self.of(ref)
            if isinstance(d, dict) and d.get("Subtype") == "Image":
                f = self.of(d.get("Filter"))
                out.append((str(name), self.of(d.get("Width")), self.of(d.get("Height")), str(f[-1] if isinstance(f, list) and f else f or "")))
        return out

    def fields(self) -> list[dict]:
        """Form fields: name, kind, value, choices, read_only, required, page (from 1) if a page shows them."""
        shown = {r[0]: n for n, p in enumerate(self.pages(), 1) for r in self.of(p.get("Annots")) or [] if isinstance(r, Ref)}
        out: list[dict] = []

        def walk(ref, name: str, above: dict) -> None:
            d = self.of(ref)
            if not isinstance(d, dict):
                return
            number = ref[0] if isinstance(ref, Ref) else 0
            own = above | {k: d[k] for k in ("FT", "V", "Ff", "Opt") if k in d}
            part = _decoded(self.plain(number, d["T"])) if isinstance(d.get("T"), bytes) else ""
            full = f"{name}.{part}" if name and part else name or part
            kids = self.of(d.get("Kids")) or []
            named = [k for k in kids if "T" in (self.of(k) or {})]
            if named:
                for k in named:
                    walk(k, full, own)
                return
            flags, kind = own.get("Ff", 0), own.get("FT")
            what = {"Tx": "text", "Sig": "signature", "Ch": "dropdown" if flags & 1 << 17 else "list", "Btn": "radio" if flags & 1 << 15 else "button" if flags & 1 << 16 else "checkbox"}.get(kind)
            if what and what not in ("signature", "button"):
                said = lambda v: _decoded(self.plain(number, v)) if isinstance(v, bytes) else "" if v is None else str(v)
                choices = [said(o[-1] if isinstance(o, list) else o) for o in self.of(own.get("Opt")) or []]
                value = self.of(own.get("V"))
                pages = [shown[r[0]] for r in [ref, *kids] if isinstance(r, Ref) and r[0] in shown]
                out.append({"name": full, "kind": what, "value": ", ".join(map(said, value)) if isinstance(value, list) else said(value), "choices": choices, "read_only": bool(flags & 1), "required": bool(flags & 2), "page": min(pages, default=None)})

        for f in self.of((self.of(self.root.get("AcroForm")) or {}).get("Fields")) or []:
            walk(f, "", {})
        return sorted(out, key=lambda f: f["page"] or 1_000_000)

    def info(self) -> dict[str, str]:
        ref = self.trailer.get("Info")
        d = self.of(ref) or {}
        n = ref[0] if isinstance(ref, Ref) else 0
        return {k: _decoded(self.plain(n, d[k])) for k in INFO if isinstance(d.get(k), bytes)}


def color(n: list[float]) -> str:
    """RRGGBB of a grey, RGB or CMYK colour with parts from 0 to 1."""
    if len(n) == 4:
        n = [(1 - c) * (1 - n[3]) for c in n[:3]]
    parts = n * 3 if len(n) == 1 else n[:3]
    return "".join(f"{max(0, min(255, int(p * 255 + 0.5))):02X}" for p in parts) or "000000"


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def page_text(file: File, page: dict) -> str:
    """A page's text on one line, white space as single spaces."""
    return re.sub(r"\s+", " ", " ".join(i["text"] for i in file.items(page))).strip()


def read_files(files: DataFrame, id_col: str = "path", content_col: str = "content", password: str = "") -> DataFrame:
    """id, page, width, height, rotation, text, title, error of every page; a file that cannot be opened has one row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch[id_col], batch[content_col], strict=True):
                try:
                    file = File(bytes(content if content is not None else b""), password)
                    title, pages = file.info().get("Title"), file.pages()
                    if not pages:
                        raise Unreadable("corrupt: the file has no pages")
                    for n, page in enumerate(pages, 1):
                        box = [float(v) for v in file.of(page.get("MediaBox")) or (0, 0, 612, 792)]
                        rows.append((name, n, box[2] - box[0], box[3] - box[1], int(file.of(page.get("Rotate")) or 0) % 360, page_text(file, page), title, None))
                except (Unreadable, ValueError, KeyError, TypeError, IndexError, zlib.error) as e:
                    rows.append((name, 0, None, None, None, None, None, str(e) if isinstance(e, Unreadable) else f"failed: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, "page", "width", "height", "rotation", "text", "title", "error"]).astype({"page": "Int64", "rotation": "Int64"})

    own = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content_col).mapInPandas(run, f"`{id_col}` {own}, page int, width double, height double, rotation int, text string, title string, error string")
