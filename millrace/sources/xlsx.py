"""Reading and writing xlsx workbooks with the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def as_text(value) -> str:
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + links[s.get(f"{REL}id")].removeprefix("/xl/").removeprefix("xl/")) for s in root.iter(f"{MAIN}sheet")]


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as book:
        return [n for n, _ in _sheets(book)]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(path: str, sheet: str | int | None = None) -> Iterator[list]:
    """Rows of a sheet: text, float, bool or None; errors as "#ERR:..."."""
    with zipfile.ZipFile(path) as book:
        sheets = _sheets(book)
        found = [p for i, (n, p) in enumerate(sheets) if (sheet is None and i == 0) or sheet == n or (isinstance(sheet, int) and sheet == i)]
        if not found:
            raise ValueError(f"no sheet {sheet!r} in {path}")
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with book.open(found[0]) as xml:
            for _, row in ElementTree.iterparse(xml):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(c, shared)
                yield cells
                row.clear()


def _value(c, shared: list[str]):
    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "e":
        return f"#ERR:{v.text}"
    return v.text if kind in ("str", "d") else float(v.text)


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_sheet(path: str, rows: Iterable[list], sheet: str = "Sheet1") -> int:
    """Writes a workbook of one sheet, its first row bold; returns the rows."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        book.writestr("_rels/.rels", head + f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", head + f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", head + f'<styleSheet xmlns="{MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        n = 0
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write((head + f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>').encode())
            for n, row in enumerate(rows, 1):
                out.write((f'<row r="{n}">' + "".join(_cell(v, f"{_name(i)}{n}", n == 1) for i, v in enumerate(row) if v is not None) + "</row>").encode())
            out.write(b"</sheetData></worksheet>")
        return n


def _cell(value, ref: str, bold: bool) -> str:
    style = ' s="1"' if bold else ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{style} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{style}><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
