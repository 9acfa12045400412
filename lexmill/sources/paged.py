"""Paged documents (PDF and the like) as a data source whose partitions are ranges of a file's pages.

What a page holds is an extractor's matter: it is given a file's bytes and says how many pages there are and what stands on
each. A deployment registers one around the parser it has; none is bundled. Each range opens its file anew, so a file has as
many ranges as its bytes need; a document too long for that comes as several files, its parts (``joined``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of a range at least, and bytes of a file for each of its ranges.
RANGE_PAGES, RANGE_BYTES = 64, 16 << 20
SCHEMA = "source string, page int, ord int, kind string, text string, image binary, error string"


@dataclass
class Span:
    """A piece of a line."""

    text: str
    bold: bool = False


@dataclass
class Block:
    """Lines of spans, a table's rows of cells, or an image's bytes (none where only its place is known)."""

    kind: str
    lines: list[list[Span]] | None = None
    rows: list[list[str | None]] | None = None
    image: bytes | None = None


class Extractor(Protocol):
    """An open document."""

    def pages(self) -> int: ...

    def blocks(self, page: int) -> list[Block]: ...


def line_text(spans: list[Span]) -> str:
    """Bold spans in markers; neighbouring ones are parted by a space."""
    out = "".join(f"**{s.text}**" if s.bold and s.text.strip() else s.text for s in spans).strip()
    return out.replace("****", " ")


def table_text(rows: list[list[str | None]]) -> str:
    cells = [[(c or "").strip() for c in row] for row in rows]
    lines = [f"| {' | '.join(row)} |" for row in cells]
    return "\n".join([lines[0], f"| {' | '.join(['---'] * len(cells[0]))} |", *lines[1:]]) if cells else ""


def page_rows(source: str, page: int, blocks: list[Block]) -> Iterator[tuple]:
    """The rows of page ``page`` (from 0): its marker, then lines, images and tables in order; tables come last."""
    rows = [("marker", f"<!--loc:page={page + 1}-->", None)]
    rows += [("image", None, b.image) if b.kind == "image" else ("line", t, None) for b in blocks if b.kind != "table" for t in ([None] if b.kind == "image" else filter(None, map(line_text, b.lines or [])))]
    rows += [("table", t, None) for b in blocks if b.kind == "table" and (t := table_text(b.rows or []))]
    for n, (kind, text, image) in enumerate(rows):
        yield source, page, n, kind, text, image, None


class _Pages(InputPartition):
    """Pages from ``first`` to before ``last``; to the end, whose place isn't known, without ``last``."""

    def __init__(self, path: str, name: str, first: int, last: int | None, error: str | None = None):
        super().__init__((path, first, last))
        self.path, self.name, self.first, self.last, self.error = path, name, first, last, error


def _place(path: str) -> tuple[object, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[object, list[tuple[str, str, int]]]:
    """The file system of ``path`` and (path, name below it, bytes) of the files there: one, a folder's with all below, or those that a last part with * matches."""
    from pyarrow import fs

    folder, _, last = path.rstrip("/").rpartition("/")
    pattern = last if "*" in last else None
    place, inside = _place(folder if pattern else path)
    info = place.get_file_info(inside)
    if info.type == fs.FileType.File:
        return place, [(inside, inside.rpartition("/")[2], info.size)]
    found = place.get_file_info(fs.FileSelector(inside, recursive=pattern is None))
    fits = lambda f: f.type == fs.FileType.File and (fnmatch(f.base_name, pattern) if pattern else not f.base_name.startswith(("_", ".")))
    return place, sorted((f.path, f.path.removeprefix(inside.rstrip("/")).lstrip("/"), f.size) for f in found if fits(f))


def _opened(place, path: str, extract: Callable[[bytes], Extractor]) -> Extractor:
    with place.open_input_stream(path) as stream:
        return extract(stream.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int | None, extract: Callable[[bytes], Extractor]):
        self.path, self.per, self.extract = path, per, extract

    def partitions(self) -> list[_Pages]:
        place, files = _files(self.path)
        out = []
        for path, name, size in files:
            if self.per is None and size <= RANGE_BYTES:  # one range: the task that reads it counts its pages
                out.append(_Pages(path, name, 0, None))
                continue
            try:
                n = _opened(place, path, self.extract).pages()
            except Exception as exc:  # noqa: BLE001 - one bad file must not stop the rest
                out.append(_Pages(path, name, 0, 0, f"{type(exc).__name__}: {exc}"))
                continue
            per = self.per or max(RANGE_PAGES, -(-n * RANGE_BYTES // size))
            out += [_Pages(path, name, at, min(n, at + per)) for at in range(0, n, per)]
        return out or [_Pages("", "", 0, 0)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        name = partition.name
        if partition.error is not None:
            yield name, None, 0, "error", None, None, partition.error
        if partition.first == partition.last:
            return
        try:
            document = _opened(_place(self.path.partition("*")[0])[0], partition.path, self.extract)
            last = document.pages() if partition.last is None else partition.last
        except Exception as exc:  # noqa: BLE001 - one bad file must not stop the rest
            yield name, None, 0, "error", None, None, f"{type(exc).__name__}: {exc}"
            return
        for page in range(partition.first, last):
            try:
                blocks = document.blocks(page)
            except Exception as exc:  # noqa: BLE001 - nor must one bad page
                yield name, page, 0, "error", None, None, f"{type(exc).__name__}: {exc}"
                continue
            yield from page_rows(name, page, blocks)


def register(spark: SparkSession, format_name: str, extract: Callable[[bytes], Extractor]) -> None:
    """Makes ``spark.read.format(format_name).load(path)`` read paged documents with ``extract``.

    Option pagesPerPartition sets the range; without it a file of up to ``RANGE_BYTES`` is one range, which the driver doesn't
    open, and a larger one has a range for as many bytes. Rows: source (the file's name below the path), page (from 0), ord, kind (marker, line, image, table or
    error), text, image, error. A file or a page that fails leaves an error row. The path is one that pyarrow can open;
    names like ``x.gz`` are compressed files, and an extractor gets what they hold.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002 - the interface's
            return _Reader(self.options["path"], int(per) if (per := self.options.get("pagesPerPartition")) else None, extract)

    spark.dataSource.register(Pages)


def joined(rows: DataFrame, whole: Column, part: Column) -> DataFrame:
    """``rows`` of files that are parts of documents, as those documents' rows: pages count on from part to part, in markers too.

    ``whole`` and ``part`` are the document's name and the part's place, from the file's source. All pages of a file count,
    failed ones too; none of a file that failed. Pages are counted before they are used, so let ``rows`` be stored ones.
    """
    files = rows.groupBy("source").agg((F.coalesce(F.max("page"), F.lit(-1)) + 1).alias("n")).select(F.col("source").alias("_file"), "n", whole.alias("_whole"), part.alias("_part"))
    before = Window.partitionBy("_whole").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", "_whole", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    page = (F.col("page") + F.col("_before")).cast("int")
    text = F.when(F.col("kind") == "marker", F.concat(F.lit("<!--loc:page="), page + 1, F.lit("-->"))).otherwise(F.col("text"))
    out = rows.join(starts, F.col("source") == F.col("_file"))
    return out.select(F.col("_whole").alias("source"), page.alias("page"), "ord", "kind", text.alias("text"), "image", "error")


def numbered_images(rows: DataFrame) -> DataFrame:
    """``rows`` with image_no: images of a source counted from 1 across its pages; a page's are counted before they are summed."""
    pages = rows.groupBy("source", "page").agg(F.count_if(F.col("kind") == "image").alias("n")).where("n > 0")
    before = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.select(F.col("source").alias("_source"), F.col("page").alias("_page"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.count_if(F.col("kind") == "image").over(Window.partitionBy("source", "page").orderBy("ord"))
    out = rows.withColumn("_own", own).join(pages, (F.col("source") == F.col("_source")) & (F.col("page") == F.col("_page")), "left")
    return out.withColumn("image_no", F.when(F.col("kind") == "image", F.col("_before") + F.col("_own")).cast("int")).drop("_source", "_page", "_before", "_own")


def page_texts(rows: DataFrame) -> DataFrame:
    """source, page, lines (how many), text: each page as Markdown, with its marker, [[IMG_n]] where an image stands, and tables behind the lines.

    Rows of errors are left out. A page without content is its marker alone.
    """
    lines = numbered_images(rows.where("kind <> 'error'"))
    said = F.when(F.col("kind") == "image", F.concat(F.lit("[[IMG_"), "image_no", F.lit("]]"))).when(F.col("kind") == "table", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    pages = lines.groupBy("source", "page").agg(F.count_if(F.col("kind") == "line").alias("lines"), F.sort_array(F.collect_list(F.struct("ord", said.alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["t"]), "\n")
    return pages.select("source", "page", "lines", F.regexp_replace(text, "\n{3,}", "\n\n").alias("text"))


def documents(rows: DataFrame) -> DataFrame:
    """source, text: documents of their pages, parted by blank lines."""
    pages = page_texts(rows).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: F.concat(F.rtrim(p["text"], F.lit("\n")), F.lit("\n"))), "\n")
    return pages.select("source", F.regexp_replace(text, "\n{3,}", "\n\n").alias("text"))


def images(rows: DataFrame) -> DataFrame:
    """source, image_no, page, image of the images whose bytes are known."""
    return numbered_images(rows).where("kind = 'image' AND image IS NOT NULL").select("source", "image_no", "page", "image")
