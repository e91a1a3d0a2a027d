"""Word documents: zipped XML read as a stream, headings by style, pages by breaks, core properties.

Files are rows of their bytes (``files.scan_files``); each is read where its row is. A file that is no such archive is an
error record: an empty text and a reason, so that one bad file does not end a job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from ..shared import small_batches

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Core properties by their XML names.
_PROPERTIES = {"creator": "author", "title": "title", "subject": "subject", "keywords": "keywords", "created": "creation_date", "modified": "mod_date"}
#: Bytes of a part after it is unpacked; more is taken for a broken or hostile archive.
MOST_BYTES = 1 << 28
#: Files whose texts a worker holds at once.
FILES = 64
_SCHEMA = "text string, metadata map<string,string>, pages array<struct<page_number:int,text:string>>, error string"


def _part(archive: zipfile.ZipFile, name: str) -> bytes:
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is too large")
    return archive.read(name)


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    """Style names by their ids."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(_part(archive, "word/styles.xml"))
    return {s.get(f"{_W}styleId", ""): (name.get(f"{_W}val") or "") for s in root.iter(f"{_W}style") if (name := s.find(f"{_W}name")) is not None}


def heading_level(style: str) -> int | None:
    words = style.strip().lower().split()
    if len(words) > 1 and words[0].startswith("heading") and words[1].isdigit() and 1 <= int(words[1]) <= 6:
        return int(words[1])
    return None


def _metadata(archive: zipfile.ZipFile) -> dict[str, str]:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(_part(archive, "docProps/core.xml"))
    found = {x.tag.rsplit("}", 1)[-1]: (x.text or "").strip() for x in root}
    return {ours: found[theirs] for theirs, ours in _PROPERTIES.items() if found.get(theirs)}


def _paragraphs(archive: zipfile.ZipFile) -> Iterator[tuple[str, str, bool]]:
    """(text, style id, begins a page) of the body's paragraphs; tables are left out, as are paragraphs inside others."""
    inside, depth, in_table = None, 0, 0
    stream = io.BytesIO(_part(archive, "word/document.xml"))
    for event, x in ElementTree.iterparse(stream, events=("start", "end")):
        if x.tag == f"{_W}tbl":
            in_table += 1 if event == "start" else -1
        elif x.tag == f"{_W}p" and not in_table:
            depth += 1 if event == "start" else -1
            if event == "start" and depth == 1:
                inside = {"text": [], "style": "", "page": False}
            elif event == "end" and not depth and inside is not None:
                yield "".join(inside["text"]), inside["style"], inside["page"]
                inside = None
                x.clear()
        elif inside is not None and event == "end" and not in_table:
            if x.tag == f"{_W}t":
                inside["text"].append(x.text or "")
            elif x.tag == f"{_W}tab":
                inside["text"].append("\t")
            elif x.tag == f"{_W}pStyle":
                inside["style"] = x.get(f"{_W}val", "")
            elif x.tag == f"{_W}lastRenderedPageBreak":
                inside["page"] = True
            elif x.tag == f"{_W}br":
                kind = x.get(f"{_W}type") or x.get("type")
                inside["page"] |= kind == "page"
                if kind is None or kind == "textWrapping":
                    inside["text"].append("\n")


def read_docx(content: bytes) -> tuple[str, dict[str, str], list[tuple[int, str]] | None]:
    """(text, metadata, pages); headings as Markdown, pages only if a break was found. A page without text has no entry."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        styles, page, pages = _styles(archive), 1, {}
        for text, style, begins in _paragraphs(archive):
            page += begins
            if text:
                level = heading_level(styles.get(style, style))
                pages.setdefault(page, []).append(f"{'#' * level} {text}" if level else text)
        whole = "\n".join(x for _, lines in sorted(pages.items()) for x in lines)
        return whole, _metadata(archive), [(k, "\n".join(v)) for k, v in sorted(pages.items())] if page > 1 else None


def parse_docx(files: DataFrame, id_col: str = "path", content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, metadata, pages, error) of files' bytes, and the columns ``keep``; null bytes are an error too. Files come
    in batches of ``BATCH_ROWS`` at most, and what was read goes on ``FILES`` at a time."""
    small_batches(files.sparkSession)
    own = [id_col, *keep]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), FILES):
                part, rows = batch.iloc[lo : lo + FILES], []
                for content in part[content_col]:
                    try:
                        text, metadata, pages = read_docx(content)
                        rows.append((text, metadata, None if pages is None else [{"page_number": k, "text": t} for k, t in pages], None))
                    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, TypeError, EOFError, RuntimeError, NotImplementedError) as e:
                        rows.append(("", {}, None, f"{type(e).__name__}: {e}"))
                found = pd.DataFrame(rows, columns=["text", "metadata", "pages", "error"], index=part.index)
                yield pd.concat([part[own], found], axis=1)

    kinds = dict(files.dtypes)
    return files.select(*own, content_col).mapInPandas(read, ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", {_SCHEMA}")
