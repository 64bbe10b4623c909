"""Folders of landed files as Spark data sources.

``register(spark)`` makes the formats known: ``filing_folder`` (``<cik>/<accession>/<name>``), ``chart_folder`` and ``csv_folder``
(``<ticker>.json``, ``<ticker>.csv``). Reading gives one column per part of a file's place, then its charset, its size in
bytes, and its text in pieces of at most ``piece_chars`` characters (nearly all files are piece 0 alone), so a file of any
size is read in bounded memory. Equalities and lists on the parts of the place are pushed down: folders that cannot match
are not listed, files that do not match are not opened. Files are packed into tasks by size, so a folder that holds a third
of all files is read by many tasks. Writing puts each row's text to its file, complete or not at all, so a task that is run
again leaves the same files.

The charset is told by a byte order mark, else by the document's own declaration, else it is UTF-8 where the bytes are valid
UTF-8, and else windows-1252, with a mark in place of bytes that mean nothing.

Options: ``path`` (a local path or a URI that Arrow can open), ``piece_chars``, ``task_bytes``, ``lines`` (``true``: pieces are whole
lines, each piece under the file's first line, so each is a table); on writing ``charset`` (rows with an ``encoding`` column say it
themselves).

Defined results: a folder that does not exist or is empty has no rows; an empty file is one empty piece; names are written
escaped, so any text, empty or null, is a name of its own; a null text is an empty file; rows of one name should be unique,
of several any one stays; hidden files (``.`` or ``_`` first) are not read.
"""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PIECE_CHARS, TASK_BYTES, BLOCK = 16_000_000, 128_000_000, 1_000_000
#: What opening a file costs, in bytes, when files are packed into tasks. Few files are dealt over more tasks; of more than
#: MANY files there are tasks enough, and as a task costs about what reading some hundred files does, opening counts a tenth.
OPEN_COST, MANY = 1_000_000, 50_000
#: Bytes in which a declared charset is looked for.
HEAD = 4096
_DECLARED = re.compile(rb"""(?:charset\s*=\s*|<\?xml[^>]{0,200}encoding\s*=\s*)["']?([A-Za-z0-9_.:-]{2,40})""", re.IGNORECASE)
_LINE = re.compile(r"[^\r\n]*(?:\r?\n|\r)")
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
TEXT = "encoding string, size bigint, piece int, text string"


def to_name(value: str | None) -> str:
    """A text as part of a path: escaped; null and the empty text by characters that escaping never leaves alone."""
    if value is None:
        return "%n"
    name = quote(value, safe="") or "%e"
    return f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name


def from_name(name: str) -> str | None:
    """What ``to_name`` wrote; names that it never writes are as they are."""
    value = {"%n": None, "%e": ""}.get(name, unquote(name))
    return value if to_name(value) == name else name


def names_of(value: str | None) -> set[str]:
    """Names that a file of that value can have: as written here, and as it is."""
    plain = {value} if value and "/" not in value and value[0] not in "._" else set()
    return {to_name(value)} | {v for v in plain if from_name(v) == value}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def told_charset(head: bytes) -> str | None:
    """What a file's first bytes say of its charset."""
    for mark, name in _MARKS:
        if head.startswith(mark):
            return name
    told = _DECLARED.search(head[:HEAD])
    if told:
        try:
            return codecs.lookup(told[1].decode("ascii")).name
        except LookupError:
            pass
    return None


def charset_of(files: pafs.FileSystem, path: str) -> str:
    with files.open_input_stream(path) as stream:
        head = stream.read(HEAD)
        told = told_charset(head)
        if told:
            return told
        decoder, block = codecs.getincrementaldecoder("utf-8")(), head
        try:
            while block:
                decoder.decode(block)
                block = stream.read(BLOCK)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return "windows-1252"
    return "utf-8"


def pieces(files: pafs.FileSystem, path: str, charset: str, chars: int) -> Iterator[str]:
    decoder, held, n, some = codecs.getincrementaldecoder(charset)("replace"), [], 0, False
    with files.open_input_stream(path) as stream:
        while True:
            block = stream.read(BLOCK)
            text = decoder.decode(block, not block)
            held.append(text)
            n += len(text)
            while n >= chars:
                whole = "".join(held)
                yield whole[:chars]
                held, n, some = [whole[chars:]], n - chars, True
            if not block:
                break
    if n or not some:
        yield "".join(held)


def tables(texts: Iterator[str]) -> Iterator[str]:
    """Pieces as whole lines, each piece under the first line of all; a line longer than a piece stays whole."""
    first, held = "", next(texts)
    for text in texts:
        end = max(held.rfind("\n"), held.rfind("\r")) + 1
        if end:
            yield first + held[:end]
            first = first or _LINE.match(held)[0]
            held = held[end:]
        held += text
    yield first + held


def texts_of(files: pafs.FileSystem, path: str, size: int, chars: int) -> tuple[str, Iterator[str]]:
    """Charset and pieces of a file. A short one is opened and read once; a longer one is read for its charset, then again."""
    if size < BLOCK and size < chars:
        with files.open_input_stream(path) as stream:
            whole = stream.read(BLOCK)
        if len(whole) < BLOCK:
            charset = told_charset(whole)
            if charset is None:
                try:
                    return "utf-8", iter([whole.decode("utf-8")])
                except UnicodeDecodeError:
                    charset = "windows-1252"
            text = whole.decode(charset, "replace")
            if len(text) < chars:
                return charset, iter([text])
    charset = charset_of(files, path)
    return charset, pieces(files, path, charset, chars)


class Files(InputPartition):
    def __init__(self, files: list[tuple[tuple, str, int]]):
        self.files = files


class FolderReader(DataSourceReader):
    def __init__(self, source: FolderSource):
        self.columns, self.suffix = source.columns, source.suffix
        self.path, self.chars = source.options["path"], int(source.options.get("piece_chars", PIECE_CHARS))
        self.task_bytes = int(source.options.get("task_bytes", TASK_BYTES))
        self.lines = source.options.get("lines", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                values = set(f.value if isinstance(f, In) else [f.value])
                c = f.attribute[0]
                self.wanted[c] = self.wanted[c] & values if c in self.wanted else values
            else:
                yield f

    def _listed(self, files: pafs.FileSystem, folder: str, place: tuple) -> Iterator[tuple[tuple, str, int]]:
        depth = len(place)
        last, wanted = depth == len(self.columns) - 1, self.wanted.get(self.columns[depth])
        if wanted is not None:  # known names: nothing else is listed
            names = sorted({n for v in wanted for n in names_of(v)})
            found = files.get_file_info([f"{folder}/{n}{self.suffix if last else ''}" for n in names])
        else:
            found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        for info in found:
            name = info.base_name
            if name[:1] in "._" or info.type != (pafs.FileType.File if last else pafs.FileType.Directory) or (last and not name.endswith(self.suffix)):
                continue
            here = (*place, from_name(name.removesuffix(self.suffix) if last else name))
            if last:
                yield here, info.path, info.size
            else:
                yield from self._listed(files, info.path, here)

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        found, size, out = [], 0, []
        entries = sorted(self._listed(files, root, ()), key=lambda x: x[1])
        cost = OPEN_COST if len(entries) <= MANY else OPEN_COST // 10
        for entry in entries:
            found.append(entry)
            size += entry[2] + cost
            if size >= self.task_bytes:
                out.append(Files(found))
                found, size = [], 0
        return [*out, Files(found)] if found or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        names = [*self.columns, *[c.split()[0] for c in TEXT.split(", ")]]
        kinds = [pa.string()] * len(self.columns) + [pa.string(), pa.int64(), pa.int32(), pa.string()]
        held, n = [], 0
        for place, path, size in partition.files:
            charset, texts = texts_of(files, path, size, self.chars)
            for k, text in enumerate(tables(texts) if self.lines else texts):
                held.append((*place, charset, size, k, text))
                n += len(text)
                if n >= min(self.chars, PIECE_CHARS) or len(held) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)


class FolderWriter(DataSourceWriter):
    def __init__(self, source: FolderSource):
        self.columns, self.suffix, self.path = source.columns, source.suffix, source.options["path"]
        self.charset = source.options.get("charset", "utf-8")

    def write(self, iterator) -> WriterCommitMessage:
        files, root = opened(self.path)
        made = None
        for row in iterator:
            row = row.asDict()
            names = [to_name(row[c]) for c in self.columns]
            folder = "/".join([root, *names[:-1]])
            if folder != made:
                files.create_dir(folder, recursive=True)
                made = folder
            part = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write((row["text"] or "").encode(row.get("encoding") or self.charset, "xmlcharrefreplace"))
            files.move(part, f"{folder}/{names[-1]}{self.suffix}")
        return WriterCommitMessage()


class FolderSource(DataSource):
    columns: tuple[str, ...] = ()
    suffix = ""

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in self.columns) + ", " + TEXT

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self)

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self)


class FilingFolder(FolderSource):
    columns = ("cik", "accession_number", "name")

    @classmethod
    def name(cls) -> str:
        return "filing_folder"


class ChartFolder(FolderSource):
    columns, suffix = ("ticker",), ".json"

    @classmethod
    def name(cls) -> str:
        return "chart_folder"


class CsvFolder(FolderSource):
    columns, suffix = ("ticker",), ".csv"

    @classmethod
    def name(cls) -> str:
        return "csv_folder"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session and lets it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FilingFolder, ChartFolder, CsvFolder):
        spark.dataSource.register(source)
