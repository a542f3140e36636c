"""Minimal office files, for tests and for the extraction queries."""

from __future__ import annotations

import io
import itertools
import re
import struct
import zipfile
from xml.sax.saxutils import escape, quoteattr

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _say(s: str) -> str:
    return escape(_BAD.sub("", s))


def _pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def docx(blocks: list) -> bytes:
    """Blocks: (style, text) paragraphs, or a list of rows of cells."""
    para = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{_say(text)}</w:t></w:r></w:p>'
    body = ""
    for b in blocks:
        if isinstance(b, tuple):
            body += para(*b)
        else:
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para('', c)}</w:tc>" for c in row) + "</w:tr>" for row in b) + "</w:tbl>"
    styles = f'<w:styles {_W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return _pack({"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows; None leaves a cell out."""
    parts, names, rels = {}, "", ""
    for i, (name, rows) in enumerate(sheets.items(), 1):
        said = ""
        for r, row in enumerate(rows, 1):
            cells = "".join(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t>{_say(str(v))}</t></is></c>' if isinstance(v, str) else f'<c r="{_letters(c)}{r}"><v>{v}</v></c>' for c, v in enumerate(row, 1) if v is not None)
            said += f'<row r="{r}">{cells}</row>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_S}><sheetData>{said}</sheetData></worksheet>"
        names += f'<sheet name={quoteattr(_BAD.sub("", name))} sheetId="{i}" r:id="rId{i}"/>'
        rels += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
    parts["xl/workbook.xml"] = f"<workbook {_S}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships {_R}>{rels}</Relationships>"
    return _pack(parts)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def pptx(slides: list[tuple[str, str]]) -> bytes:
    """Slides of (title, text)."""
    parts, ids, rels = {}, "", ""
    for i, (title, text) in enumerate(slides, 1):
        shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{_say(t)}</a:t></a:r></a:p></p:txBody></p:sp>'
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {_P}><p:cSld><p:spTree>{shape('title', title)}{shape('body', text)}</p:spTree></p:cSld></p:sld>"
        ids += f'<p:sldId id="{255 + i}" r:id="rId{i}"/>'
        rels += f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>'
    parts["ppt/presentation.xml"] = f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = f"<Relationships {_R}>{rels}</Relationships>"
    return _pack(parts)


def ods(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows as an OpenDocument spreadsheet; equal neighbouring cells are written once with a repeat."""
    space = "urn:oasis:names:tc:opendocument:xmlns:"
    heads = f'xmlns:office="{space}office:1.0" xmlns:table="{space}table:1.0" xmlns:text="{space}text:1.0"'

    def cell(value, times):
        again = f' table:number-columns-repeated="{times}"' if times > 1 else ""
        if value is None:
            return f"<table:table-cell{again}/>"
        if isinstance(value, bool):
            return f'<table:table-cell{again} office:value-type="boolean" office:boolean-value="{str(value).lower()}"/>'
        if isinstance(value, (int, float)):
            return f'<table:table-cell{again} office:value-type="float" office:value="{value}"/>'
        return f'<table:table-cell{again} office:value-type="string"><text:p>{_say(value)}</text:p></table:table-cell>'

    body = ""
    for name, rows in sheets.items():
        said = "".join("<table:table-row>" + "".join(cell(v, len(list(same))) for v, same in itertools.groupby(row)) + "</table:table-row>" for row in rows)
        body += f'<table:table table:name={quoteattr(_BAD.sub("", name))}>{said}<table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="16000"/></table:table-row></table:table>'
    return _pack({"content.xml": f"<office:document-content {heads}><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>"})


def xlsb(sheets: dict[str, list[list]]) -> bytes:
    """Sheets of rows as a binary workbook; strings are shared."""

    def record(kind, body=b""):
        size, out = len(body), bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
        while size > 127:
            out += bytes([size & 127 | 128])
            size >>= 7
        return out + bytes([size]) + body

    wide = lambda x: (len(x.encode("utf-16-le")) // 2).to_bytes(4, "little") + x.encode("utf-16-le")
    number = lambda n: n.to_bytes(4, "little")
    shared: dict[str, int] = {}
    parts, book, rels = {}, b"", ""
    for i, (name, rows) in enumerate(sheets.items(), 1):
        out = b""
        for r, row in enumerate(rows):
            out += record(0, number(r) + bytes(21))
            for c, v in enumerate(row):
                at = number(c) + bytes(4)
                if isinstance(v, bool):
                    out += record(4, at + bytes([v]))
                elif isinstance(v, int) and abs(v) < 1 << 28:
                    out += record(2, at + number((v << 2 | 2) & 0xFFFFFFFF))
                elif isinstance(v, (int, float)):
                    out += record(5, at + struct.pack("<d", v))
                elif v is not None:
                    out += record(7, at + number(shared.setdefault(v, len(shared))))
        parts[f"xl/worksheets/sheet{i}.bin"] = out
        book += record(156, number(0) + number(i) + wide(f"rId{i}") + wide(name))
        rels += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.bin"/>'
    strings = b"".join(record(19, bytes(1) + wide(x)) for x in shared)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {**parts, "xl/workbook.bin": book, "xl/sharedStrings.bin": strings, "xl/_rels/workbook.bin.rels": f"<Relationships {_R}>{rels}</Relationships>".encode()}.items():
            z.writestr(name, data)
    return out.getvalue()
