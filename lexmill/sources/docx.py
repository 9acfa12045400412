"""Word documents to Markdown with location markers, from the package's XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SECTION_CHARS = 80


def _on(run, name: str) -> bool:
    mark = run.find(f"{W}rPr/{W}{name}")
    return mark is not None and mark.get(f"{W}val") not in ("0", "false", "none")


def rich_text(paragraph) -> str:
    """Bold and italic runs in markers that leave outer spaces outside; neighbouring bold runs are one."""
    out = []
    for run in paragraph.iter(f"{W}r"):
        text = "".join("\n" if x.tag == f"{W}br" else "\t" if x.tag == f"{W}tab" else x.text or "" for x in run if x.tag in (f"{W}t", f"{W}br", f"{W}tab"))
        core = text.strip()
        mark = "**" if core and _on(run, "b") else "*" if core and _on(run, "i") else ""
        if mark:
            lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            text = f"{lead}{mark}{core}{mark}{trail}"
        out.append(text)
    return re.sub(r"\*\*\s*\*\*", " ", "".join(out))


def _rows(table) -> list[str]:
    rows = [["<br>".join(filter(None, (rich_text(p).strip() for p in cell.iter(f"{W}p")))).replace("|", "\\|") for cell in row.iter(f"{W}tc")] for row in table.iter(f"{W}tr")]
    lines = [f"| {' | '.join(r)} |" for r in rows]
    return lines[:1] + [f"|{' --- |' * len(rows[0])}"] + lines[1:] if rows else []


def extract_docx(content: bytes) -> str:
    """Paragraphs and tables in body order; a heading also leaves a section marker; an image leaves a placeholder."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{W}body")
    out, images = [], 0
    for item in body if body is not None else ():
        if item.tag == f"{W}tbl":
            out += ["", *_rows(item), ""]
        elif item.tag == f"{W}p":
            text, style = rich_text(item).strip(), item.find(f"{W}pPr/{W}pStyle")
            heading = re.match(r"(?i)(?:heading|titre)\s*(\d)", style.get(f"{W}val", "")) if style is not None else None
            for _ in item.iter(f"{A}blip"):
                out.append(f"[[IMG_{images}]]")
                images += 1
            if heading and text:
                out += [f"<!--loc:section={text.replace('*', '')[:SECTION_CHARS]}-->", f"{'#' * min(6, int(heading[1]))} {text}"]
            elif text:
                out.append(text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
