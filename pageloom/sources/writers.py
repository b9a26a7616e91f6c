"""Writing of pages, books, reports and studies."""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from itertools import groupby
from operator import itemgetter
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from ..operators.ordered import run_of
from ..functions.pystr import lstrip
from ..functions.scalar import escape_xml
from ..operators.review import parsed_blocks, upsert
from . import epub


def pages(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """OCR results as Parquet, a folder for each book."""
    results.write.mode(mode).partitionBy("book_id").parquet(path)


def read_pages(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Pages that ``pages`` has written, with these columns (as in a schema); the book is the folder's name as it is."""
    return spark.read.schema(f"{columns}, book_id string").parquet(path)


def save_edits(spark: SparkSession, path: str, edits: DataFrame, columns: str, text: str = "text") -> None:
    """Texts of ``edits`` (book_id, page_no, text) put into the pages that ``pages`` has written.

    Only the folders of books with an edit of a page that is there are read and written anew; Spark stages the new files
    beside them and swaps whole folders once all tasks have ended, so a failed attempt changes nothing, and what is
    saved twice stands there once. Edits of unknown pages are ignored; of several edits of a page the last by text counts.
    """
    fresh = edits.where("book_id is not null and page_no is not null").groupBy("book_id", "page_no").agg(F.max(text).alias(text))
    known = read_pages(spark, path, columns).select("book_id", "page_no").join(fresh, ["book_id", "page_no"], "left_semi")
    touched = known.select("book_id").distinct()
    rows = read_pages(spark, path, columns)
    found = upsert(rows.join(touched, "book_id", "left_semi"), fresh, text).select(*rows.columns)
    found.repartition("book_id", run_of()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


#: Of boxes by category; others are drawn in the last colour.
COLOURS = {"Title": "#b00020", "Section-header": "#d2691e", "Text": "#1e66d0", "List-item": "#2e8b57", "Table": "#8a2be2", "Picture": "#c71585", "Caption": "#008b8b", "Footnote": "#708090", "Formula": "#556b2f", "Page-header": "#b8860b", "Page-footer": "#a0522d", None: "#000000"}


def overlay(raw: Column, image: Column) -> Column:
    """An SVG that draws a page's layout over its image (a file beside it): a box for each block with four numbers, in its category's colour, named by it. Null where the layout is no list of blocks."""
    blocks = F.filter(parsed_blocks(raw), lambda b: (F.size(b["bbox"]) == 4) & ~F.exists(b["bbox"], lambda x: x.isNull()))
    number = lambda x: F.format_string("%.2f", x)
    colours = F.create_map(*[F.lit(x) for k, v in COLOURS.items() if k for x in (k, v)])

    def box(b: Column) -> Column:
        x1, y1, x2, y2 = (F.get(b["bbox"], F.lit(k)) for k in range(4))
        category = F.coalesce(b["category"], F.lit("Text"))
        colour = F.coalesce(F.try_element_at(colours, category), F.lit(COLOURS[None]))
        return F.concat(F.lit('<rect x="'), number(F.least(x1, x2)), F.lit('" y="'), number(F.least(y1, y2)), F.lit('" width="'), number(F.abs(x2 - x1)), F.lit('" height="'), number(F.abs(y2 - y1)), F.lit('" fill="none" stroke="'), colour, F.lit('"><title>'), escape_xml(category), F.lit("</title></rect>"))

    edge = lambda a, b: number(F.coalesce(F.array_max(F.transform(blocks, lambda x: F.greatest(F.get(x["bbox"], F.lit(a)), F.get(x["bbox"], F.lit(b))))), F.lit(0.0)))
    made = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), edge(0, 2), F.lit(" "), edge(1, 3), F.lit('"><image href="'), escape_xml(image), F.lit('" width="100%" height="100%"/>'), F.array_join(F.transform(blocks, box), ""), F.lit("</svg>"))
    return F.when(lstrip(raw).startswith("[") & F.try_parse_json(raw).isNotNull(), made)


def page_files(results: DataFrame, folder: str, drawn: bool = False) -> DataFrame:
    """(book_id, page_no, written): ``page_NNNN.md``, ``_nohf.md`` and ``.json`` of each page in a shared folder, by book; ``drawn``: ``.svg`` too, its layout over ``page_NNNN.jpg``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = []
            for r in b.itertuples(index=False):
                stem = f"{safe(r.book_id)}/page_{r.page_no:04d}"
                parts = {".md": r.text, "_nohf.md": r.text_nohf, ".json": indented(r.raw), ".svg": r.svg}
                for suffix, text in parts.items():
                    if text is not None:
                        _put(folder, stem + suffix, text.encode())
                n.append(sum(x is not None for x in parts.values()))
            yield b[["book_id", "page_no"]].assign(written=n)

    svg = overlay(F.col("raw"), F.format_string("page_%04d.jpg", "page_no")) if drawn else F.lit(None).cast("string")
    return results.select("book_id", "page_no", "text", "text_nohf", "raw", svg.alias("svg")).mapInPandas(run, "book_id string, page_no int, written int")


def indented(raw: str | None) -> str | None:
    """JSON with an indent of two; what isn't JSON stays as it is."""
    try:
        return raw if raw is None else json.dumps(json.loads(raw), ensure_ascii=False, indent=2)
    except ValueError:
        return raw


def text_files(rows: DataFrame, folder: str, order: tuple[str, ...] = ("block",), text: str = "text", suffix: str = ".md") -> DataFrame:
    """(book_id, path, n_chars, digest): a text file for each book in a shared folder, from rows in this order, written as they come: a book is never held as a whole. ``digest``: MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in groupby(each(batches), itemgetter("book_id")):
            n, state = 0, hashlib.md5(usedforsecurity=False)
            with stream(folder, file := f"{safe(name)}{suffix}") as f:
                for r in own:
                    data = (r[text] or "").encode()
                    n += len(r[text] or "")
                    state.update(data)
                    f.write(data)
            yield pa.RecordBatch.from_pydict({"book_id": pa.array([name], pa.string()), "path": [f"{folder}/{file}"], "n_chars": [n], "digest": [state.hexdigest()]})

    dealt = rows.select("book_id", *order, text).repartition("book_id").sortWithinPartitions("book_id", *order)
    return dealt.mapInArrow(run, "book_id string, path string, n_chars bigint, digest string")


def epub_files(chapters: DataFrame, folder: str, author: str = "Unknown", language: str = "en", date: str = "1970-01-01", suffix: str = ".epub") -> DataFrame:
    """(book_id, path, n_chapters): an EPUB for each book in a shared folder, from rows (book_id, chapter_no, title, block, part, text) of ``chapters.of_blocks``: first a book's titles, then its text, converted and compressed as it comes."""
    titles = chapters.groupBy("book_id", "chapter_no").agg(F.min("title").alias("title"))
    rows = titles.select("book_id", F.lit(0).alias("kind"), "chapter_no", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("part"), F.col("title").alias("text"))
    rows = rows.unionByName(chapters.select("book_id", F.lit(1).alias("kind"), "chapter_no", "block", "part", "text"))
    order = ["book_id", "kind", "chapter_no", "block", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own in groupby(each(batches), itemgetter("book_id")):
            kinds = groupby(own, itemgetter("kind"))
            names = [r["text"] or "" for r in next(kinds)[1]]
            texts = ((r["text"] or "" for r in part) for _, part in groupby(next(kinds)[1], itemgetter("chapter_no")))
            meta = epub.Metadata(name or "", author, language, f"urn:book:{name}", date, f"{date}T00:00:00Z")
            with stream(folder, file := f"{safe(name)}{suffix}") as f:
                epub.write(f, meta, names, texts)
            yield pa.RecordBatch.from_pydict({"book_id": pa.array([name], pa.string()), "path": [f"{folder}/{file}"], "n_chapters": pa.array([len(names)], pa.int32())})

    dealt = rows.repartition("book_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "book_id string, path string, n_chapters int")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 64):  # few rows are Python objects at a time
            yield from b.slice(k, 64).to_pylist()


def files(books: DataFrame, folder: str, column: str, suffix: str) -> DataFrame:
    """(book_id, path): a file for each book in a shared folder; a task that runs again writes the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [f"{safe(name)}{suffix}" for name in b["book_id"]]
            for name, data in zip(names, b[column], strict=True):
                _put(folder, name, bytes(data))
            yield pd.DataFrame({"book_id": b["book_id"], "path": [f"{folder}/{name}" for name in names]})

    return books.select("book_id", column).mapInPandas(run, "book_id string, path string")


def _put(folder: str, name: str, data: bytes) -> None:
    with stream(folder, name) as f:
        f.write(data)


@contextmanager
def stream(folder: str, name: str) -> Iterator[BinaryIO]:
    """A file to write in, which stands there whole or not at all, however often it is tried; in any file system that Arrow knows. Only the folder may be a URI."""
    system, base = FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (LocalFileSystem(), folder)
    at = f"{base}/{name}"
    system.create_dir(at.rpartition("/")[0])
    part = f"{at}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(part) as f:
            yield f
        system.move(part, at)
    except BaseException:
        with suppress(OSError):
            system.delete_file(part)
        raise


def safe(name: str | None) -> str:
    """A book's id as the name of a file or folder, another one for each id: what may not stand there is written as %XX, in UTF-8."""
    escaped = re.sub(r"[^\w .-]|\A\.", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name or "")
    return escaped or ("%" if name is None else "%00")


def _jpegs(images: DataFrame, change: Callable, quality: int) -> DataFrame:
    """Adds ``jpeg``, each image upright and changed; null where one can't be read or no image library is there."""

    def one(data: bytes) -> bytes | None:
        try:
            from PIL import Image, ImageOps

            out = io.BytesIO()
            change(ImageOps.exif_transpose(Image.open(io.BytesIO(data)))).convert("RGB").save(out, "JPEG", quality=quality)
            return out.getvalue()
        except Exception:  # noqa: BLE001  an unreadable image gives none
            return None

    def run(content: pd.Series) -> pd.Series:
        return content.map(one)

    return images.withColumn("jpeg", F.pandas_udf(run, "binary")("content"))


def resized_images(images: DataFrame, target: int = 1150, quality: int = 95) -> DataFrame:
    """Images (path, content) with their shorter edge at most ``target``."""

    def change(image):
        short = min(image.size)
        return image.resize(tuple(int(x * (target / short)) for x in image.size)) if 0 < target < short else image

    return _jpegs(images, change, quality)


def rotated_images(images: DataFrame, degrees: int, quality: int = 95) -> DataFrame:
    """Images (path, content) turned counter-clockwise, the whole image kept."""
    return _jpegs(images, lambda image: image.rotate(degrees, expand=True), quality)


def study(results: DataFrame, path: str) -> None:
    """Results of an accuracy study as JSON lines."""
    results.write.mode("overwrite").json(path)


def digests(rows: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, n_chars, digest): length and MD5 of the texts of each key put together in order, read row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(each(batches), itemgetter(*keys)):
            n, state = 0, hashlib.md5(usedforsecurity=False)
            for r in own:
                n += len(r[text] or "")
                state.update((r[text] or "").encode())
            values = [*(key if len(keys) > 1 else (key,)), n, state.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    narrow = rows.select(*keys, *order, text)
    names = [f"{k} {narrow.schema[k].dataType.simpleString()}" for k in keys]
    schema = pa.schema([*((k, to_arrow(narrow.schema[k].dataType)) for k in keys), ("n_chars", pa.int64()), ("digest", pa.string())])
    dealt = narrow.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join([*names, "n_chars bigint, digest string"]))
