"""Workbooks, documents and presentations: ZIP packages of XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from quire.operators.sheets import BUILTIN, formatted

MAX_BYTES = 100 * 1024 * 1024


def local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def kids(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [k for k in node if local(k) == name]


def kid(node: ET.Element | None, *names: str) -> ET.Element | None:
    for name in names:
        node = next(iter(kids(node, name)), None)
    return node


def attr(node: ET.Element | None, name: str, default=None):
    return default if node is None else next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def below(node: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (n for n in (node.iter() if node is not None else ()) if local(n) == name)


class Package:
    def __init__(self, content: bytes):
        if content[:4] == b"\xd0\xcf\x11\xe0":
            raise ValueError("the file is encrypted")
        if content[:2] != b"PK":
            raise ValueError("the file is no package")
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, path: str) -> ET.Element | None:
        return ET.fromstring(self.zip.read(path)) if path in self.names else None

    def links(self, path: str) -> dict[str, tuple[str, str]]:
        """Relationships of a part: id to (kind, path)."""
        folder, name = posixpath.split(path)
        found = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        return {attr(r, "Id"): (attr(r, "Type", "").rsplit("/", 1)[-1], resolved(folder, attr(r, "Target", ""))) for r in kids(found, "Relationship")}


def resolved(folder: str, target: str) -> str:
    """A relative path against a folder; one that begins with a slash starts at the root."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))


def packed(parts: dict[str, str | bytes]) -> bytes:
    """A ZIP of parts in order; a part is deflated only if that makes it smaller. The same parts give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            data = body.encode() if isinstance(body, str) else body
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            small = len(zipfile.zlib.compress(data)) < len(data)
            z.writestr(info, data, zipfile.ZIP_DEFLATED if small else zipfile.ZIP_STORED)
    return out.getvalue()


# workbooks


def reference(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)([0-9]+)", ref or "")
    if not m:
        return None
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def column_name(index: int) -> str:
    name, n = "", index + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def read_workbook(content: bytes) -> list[tuple[str, int, int, str, float | None]]:
    """(sheet, row, col, text, number) of cells of the sheets that are shown; hidden rows are skipped, cached values are taken."""
    p = Package(content)
    book, links = p.xml("xl/workbook.xml"), p.links("xl/workbook.xml")
    shared = ["".join(t.text or "" for t in below(si, "t")) for si in kids(p.xml("xl/sharedStrings.xml"), "si")]
    styles = p.xml("xl/styles.xml")
    codes = BUILTIN | {int(attr(f, "numFmtId")): attr(f, "formatCode") for f in below(kid(styles, "numFmts"), "numFmt")}
    formats = [codes.get(int(attr(x, "numFmtId", 0))) for x in kids(kid(styles, "cellXfs"), "xf")]
    out = []
    for s in kids(kid(book, "sheets"), "sheet"):
        if attr(s, "state") in ("hidden", "veryHidden"):
            continue
        sheet = p.xml(links.get(s.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"), ("", ""))[1])
        for row in kids(kid(sheet, "sheetData"), "row"):
            if attr(row, "hidden") == "1":
                continue
            for c in kids(row, "c"):
                at, kind, raw = reference(attr(c, "r")), attr(c, "t", "n"), kid(c, "v")
                value = (raw.text or "") if raw is not None else None
                number, style = None, int(attr(c, "s", 0))
                if kind == "s":
                    text = shared[int(value)] if value and value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in below(kid(c, "is"), "t"))
                elif kind == "b":
                    text = "TRUE" if value == "1" else "FALSE"
                elif kind == "e":
                    text = value or "#ERROR"
                elif kind == "str":
                    text = value or ""
                else:
                    number = float(value) if value else None
                    text = formatted(number, formats[style] if style < len(formats) else None) if number is not None else ""
                if at and text:
                    out.append((attr(s, "name"), *at, text, number))
    return out


def write_workbook(sheets: list[tuple[str, list[tuple[int, int, str, float | None, bool, bool]]]]) -> bytes:
    """A workbook of named sheets with cells (row, col, text, number, bold, bordered); names are already fit and different."""
    main, rel, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts: dict[str, str | bytes] = {}
    kinds = ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"]
    overrides = [f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)]
    parts["[Content_Types].xml"] = f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds[0]}"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{"".join(overrides)}</Types>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, (name, _) in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="s{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{rel}">{links}<Relationship Id="st" Type="{office}/styles" Target="styles.xml"/></Relationships>'
    side = "".join(f'<{s} style="thin"/>' for s in ("left", "right", "top", "bottom"))
    xfs = "".join(f'<xf fontId="{b}" fillId="0" borderId="{r}" numFmtId="0"/>' for r in (0, 1) for b in (0, 1))
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="2"><border/><border>{side}</border></borders><cellXfs count="4">{xfs}</cellXfs></styleSheet>'
    for i, (_, cells) in enumerate(sheets, 1):
        rows: dict[int, list[str]] = {}
        for r, c, text, number, bold, bordered in sorted(cells, key=lambda x: x[:2]):
            ref, style = f"{column_name(c)}{r + 1}", bold + 2 * bordered
            body = f'<c r="{ref}" s="{style}"><v>{number!r}</v></c>' if number is not None else f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
            rows.setdefault(r, []).append(body)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{"".join(f"""<row r="{r + 1}">{"".join(cs)}</row>""" for r, cs in rows.items())}</sheetData></worksheet>'
    return packed(parts)


# documents and presentations


def read_document(content: bytes) -> list[tuple[str, str]]:
    """(kind, text) of paragraphs and table rows in order: deleted text is left out, inserted text kept, hidden runs dropped."""
    body = kid(Package(content).xml("word/document.xml"), "body")

    def text(node: ET.Element) -> str:
        out = []
        for n in node:
            name = local(n)
            if name in ("del", "moveFrom") or (name == "r" and kid(n, "rPr", "vanish") is not None):
                continue
            out.append(n.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else text(n) if name not in ("rPr", "pPr") else "")
        return "".join(out)

    out = []
    for block in body if body is not None else ():
        if local(block) == "p":
            style = attr(kid(block, "pPr", "pStyle"), "val", "")
            out.append(("heading" if style.lower().startswith("heading") else "paragraph", text(block)))
        elif local(block) == "tbl":
            out += [("row", "\t".join("\n".join(text(p) for p in kids(tc, "p")) for tc in kids(tr, "tc"))) for tr in kids(block, "tr")]
    return out


def write_document(blocks: list[tuple[str, str]]) -> bytes:
    """A document of (kind, text) blocks: heading, paragraph, or row, whose cells tabs part."""
    w, rel = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships"
    run = lambda t: "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in t.split("\n"))
    para = lambda t, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r>{run(t)}</w:r></w:p>'
    body, table = [], []
    for kind, text in [*blocks, ("end", "")]:
        if kind == "row":
            table.append("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in text.split("\t")) + "</w:tr>")
            continue
        if table:
            body.append(f"<w:tbl>{''.join(table)}</w:tbl>")
            table = []
        if kind != "end":
            body.append(para(text, "Heading1" if kind == "heading" else ""))
    return packed({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>',
    })


def read_presentation(content: bytes) -> list[tuple[int, int, str, str]]:
    """(slide, shape, placeholder, text) of all shapes with text, slides in the order of the presentation."""
    p = Package(content)
    links = p.links("ppt/presentation.xml")
    rid = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = []
    for n, s in enumerate(kids(kid(p.xml("ppt/presentation.xml"), "sldIdLst"), "sldId"), 1):
        slide = p.xml(links.get(s.attrib.get(rid), ("", ""))[1])
        for k, shape in enumerate(below(slide, "sp")):
            text = "\n".join("".join(t.text or "" for t in below(par, "t")) for par in kids(kid(shape, "txBody"), "p"))
            if text.strip():
                out.append((n, k, attr(kid(shape, "nvSpPr", "nvPr", "ph"), "type", ""), text))
    return out


def write_presentation(slides: list[list[tuple[str, str]]]) -> bytes:
    """A presentation of slides of (placeholder, text)."""
    a, pns, r, rel = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
    parts: dict[str, str | bytes] = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{r}/officeDocument" Target="ppt/presentation.xml"/></Relationships>',
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{pns}" xmlns:r="{r}"><p:sldIdLst>{"".join(f"""<p:sldId id="{255 + i}" r:id="s{i}"/>""" for i in range(1, len(slides) + 1))}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{rel}">{"".join(f"""<Relationship Id="s{i}" Type="{r}/slide" Target="slides/slide{i}.xml"/>""" for i in range(1, len(slides) + 1))}</Relationships>',
    }
    for i, shapes in enumerate(slides, 1):
        made = "".join(f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="s{k}"/><p:nvPr>{f"""<p:ph type="{kind}"/>""" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in text.split(chr(10)))}</p:txBody></p:sp>' for k, (kind, text) in enumerate(shapes))
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="{pns}" xmlns:a="{a}"><p:cSld><p:spTree>{made}</p:spTree></p:cSld></p:sld>'
    return packed(parts)


READERS = {
    "xlsx": (lambda b: [(f"{s}!{column_name(c)}{r + 1}", t, x) for s, r, c, t, x in read_workbook(b)]),
    "docx": (lambda b: [(f"{n}:{k}", t, None) for n, (k, t) in enumerate(read_document(b))]),
    "pptx": (lambda b: [(f"{n}.{k}:{ph}", t, None) for n, k, ph, t in read_presentation(b)]),
}


def read_files(files: DataFrame, kind: str, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """id, ord, place, text, number (of number cells) and error of office files of one kind; a file over the size limit or damaged has one row with its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch[id_col], batch[content_col], strict=True):
                try:
                    if content is None or len(content) > MAX_BYTES:
                        raise ValueError("the file is missing or too large")
                    rows += [(name, n, place, text, number, None) for n, (place, text, number) in enumerate(READERS[kind](bytes(content)))]
                except (ValueError, KeyError, IndexError, ET.ParseError, zipfile.BadZipFile) as e:
                    rows.append((name, 0, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, "ord", "place", "text", "number", "error"]).astype({"number": "float64"})

    own = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content_col).mapInPandas(run, f"`{id_col}` {own}, ord int, place string, text string, number double, error string")
