"""Writing tables and images: one file a task, or one in all, moved to its place when all tasks are done.

The primary unit is empty (or the image itself), a table is one BINTABLE extension. Options: ``kind``
(table, image), ``extname``, ``bitpix`` of images (default by the type of raw), ``bzero``, ``bscale``,
``bayer``, ``height`` (rows of a plane: the last one may then have fewer, which an image extension holds),
``header`` (more "KEY=value" cards, by newlines), ``single`` (one file: tasks write their rows, which are
joined in the order of partitions). A table's header has its number of rows and its widest text, so a task
lays its batches aside, in memory up to HELD_BYTES and beyond in a temporary file of its own, and encodes
them one by one when it knows; so does an image's one task, which holds the image's samples.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from ..layout import BITPIX, CARD, LAST_PLANE, padded
from .storage import file_system

# The letter of a Spark type.
TYPES = {"boolean": "L", "tinyint": "S", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A", "binary": "A"}
#: Bytes of a table's batches that a task holds in memory.
HELD_BYTES = 32 << 20
#: Bytes of rows that are encoded or copied at a time.
BATCH_BYTES = 8 << 20
_NUMPY = {"L": "u1", "S": "i1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
_BITPIX_OF = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": -32, "double": -64}


def card(keyword: str, value: object = None, comment: str | None = None) -> bytes:
    """A header card: numbers and logicals right-aligned to column 30, text quoted, quotes doubled."""
    if value is None:
        return f"{keyword:<8}{comment or ''}"[:CARD].ljust(CARD).encode("ascii", "replace")
    if isinstance(value, bool):
        body = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        body = f"{"'" + value.replace("'", "''").ljust(8) + "'":<20}"
    elif isinstance(value, float):
        text = repr(value).upper()
        body = f"{text if '.' in text or 'E' in text or 'N' in text else text + '.0':>20}"
    else:
        body = f"{value:>20}"
    return f"{keyword:<8}= {body}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD).encode("ascii", "replace")


def header(cards: list[bytes]) -> bytes:
    data = b"".join(cards) + b"END".ljust(CARD)
    return data.ljust(padded(len(data)))


def more_cards(text: str) -> list[bytes]:
    """"KEY=value" lines to cards; numbers, T and F are typed, all else is text."""
    out = []
    for line in filter(None, text.split("\n")):
        key, _, value = line.partition("=")
        typed: object = value
        if value in ("T", "F"):
            typed = value == "T"
        else:
            for kind in (int, float):
                try:
                    typed = kind(value)
                    break
                except ValueError:
                    pass
        out.append(card(key.strip(), typed))
    return out


EMPTY_PRIMARY = header([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)])


@dataclass
class Extent:
    """What a column's format depends on: the bytes of its widest text, or the fewest and the most values of its lists."""

    most: int = 0
    least: int | None = None
    nulls: bool = False

    @staticmethod
    def of(col: pa.Array, kind: T.DataType) -> Extent:
        if isinstance(kind, T.ArrayType):
            size = pc.list_value_length(col)
            return Extent(pc.max(size).as_py() or 0, pc.min(size).as_py() or 0, col.null_count > 0) if len(col) else Extent()
        if TYPES.get(kind.simpleString()) == "A":
            return Extent(pc.max(pc.binary_length(col)).as_py() or 0) if len(col) else Extent()
        return Extent()

    def __or__(self, other: Extent) -> Extent:
        least = [x.least for x in (self, other) if x.least is not None]
        return Extent(max(self.most, other.most), min(least, default=None), self.nulls or other.nulls)

    def form(self, kind: T.DataType) -> str:
        """TFORM."""
        if isinstance(kind, T.ArrayType):
            letter = TYPES.get(kind.elementType.simpleString())
            if letter in (None, "A") or self.nulls or self.least not in (None, self.most):
                raise ValueError("an array column needs numbers, and as many in each row")
            return f"{self.most}{letter}"
        name = "bigint" if kind.simpleString() in ("timestamp", "timestamp_ntz") else kind.simpleString()
        letter = TYPES.get(name)
        if letter is None:
            raise ValueError(f"a column of {name} can't be written; cast it")
        return f"{self.most or 1}A" if letter == "A" else f"1{letter}"


def width(form: str) -> int:
    """Bytes of a cell of a format that is written here."""
    return int(form[:-1]) * (1 if form[-1] in "LA" else np.dtype(_NUMPY[form[-1]]).itemsize)


def encode_column(col: pa.Array, kind: T.DataType, form: str) -> np.ndarray:
    """The cells as rows of bytes; a null is 0, NaN, blank or an empty logical."""
    if isinstance(kind, T.ArrayType):
        return encode_column(col.flatten(), kind.elementType, f"1{form[-1]}").reshape(len(col), width(form))
    letter = form[-1]
    if kind.simpleString() in ("timestamp", "timestamp_ntz"):
        col = col.cast(pa.timestamp("us", getattr(col.type, "tz", None))).cast(pa.int64())
    if letter == "A":
        data = pc.fill_null(col.cast(pa.binary()), b"")
        at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        cells = np.full((len(data), width(form)), 32, np.uint8)
        text = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
        cells.reshape(-1)[np.arange(len(text)) + np.repeat(np.arange(len(data)) * width(form) - (at[:-1] - at[0]), np.diff(at))] = text
        return cells
    if letter == "L":
        x = pc.fill_null(pc.if_else(col, pa.scalar(84, pa.uint8()), pa.scalar(70, pa.uint8())), 0).to_numpy(zero_copy_only=False)
    else:
        x = pc.fill_null(col, float("nan") if letter in "ED" else 0).to_numpy(zero_copy_only=False).astype(_NUMPY[letter])
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)


def table_head(schema: T.StructType, forms: list[str], rows: int, extname: str | None, more: list[bytes]) -> bytes:
    """A file's bytes up to its table's rows."""
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", sum(map(width, forms))), card("NAXIS2", rows), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms))]
    for i, (f, form) in enumerate(zip(schema.fields, forms), 1):
        cards += [card(f"TTYPE{i}", f.name), card(f"TFORM{i}", form)]
    return EMPTY_PRIMARY + header(cards + ([card("EXTNAME", extname)] if extname else []) + more)


def table_rows(batches: Iterable[pa.RecordBatch], schema: T.StructType, forms: list[str]) -> Iterator[bytes]:
    step = max(1, BATCH_BYTES // max(1, sum(map(width, forms))))
    for whole in batches:
        for b in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
            if forms:
                yield np.concatenate([encode_column(b.column(i), f.dataType, forms[i]) for i, f in enumerate(schema.fields)], axis=1).tobytes()


def table_end(forms: list[str], rows: int) -> bytes:
    size = sum(map(width, forms)) * rows
    return b"\0" * (padded(size) - size)


def table_bytes(batches: Iterable[pa.RecordBatch], schema: T.StructType, extname: str | None, more: list[bytes]) -> Iterator[bytes]:
    """A whole file with one binary table; batches are kept aside until their number of rows is known."""
    with Aside(schema) as held:
        held.take(batches)
        forms = held.forms()
        yield table_head(schema, forms, held.rows, extname, more)
        yield from table_rows(held.again(), schema, forms)
        yield table_end(forms, held.rows)


class Aside:
    """Batches to be read again, their number of rows and what their formats depend on."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows, self.extents = schema, 0, [Extent() for _ in schema.fields]
        self.held, self.bytes, self.file, self.out, self.ended = [], 0, None, None, False

    def __enter__(self) -> Aside:
        return self

    def __exit__(self, *_: object) -> None:
        if self.file is not None:
            self.file.close()

    def take(self, batches: Iterable[pa.RecordBatch]) -> None:
        for b in batches:
            self.rows += b.num_rows
            self.extents = [x | Extent.of(b.column(i), f.dataType) for i, (x, f) in enumerate(zip(self.extents, self.schema.fields))]
            self.held.append(b)
            self.bytes += b.get_total_buffer_size()
            if self.bytes > HELD_BYTES:
                if self.out is None:
                    self.file = tempfile.TemporaryFile()
                    self.out = pa.ipc.new_stream(self.file, b.schema)
                for x in self.held:
                    self.out.write_batch(x)
                self.held, self.bytes = [], 0

    def forms(self) -> list[str]:
        return [x.form(f.dataType) for x, f in zip(self.extents, self.schema.fields)]

    def again(self) -> Iterator[pa.RecordBatch]:
        if self.out is not None:
            if not self.ended:
                self.out.close()
                self.ended = True
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
        yield from self.held


def image_bytes(planes: np.ndarray, rest: np.ndarray, more: list[bytes], bitpix: int, calibration: list[bytes]) -> Iterator[bytes]:
    """A whole file whose primary unit is a stack of planes, height by width each; rest are the rows of a last plane that isn't full."""
    n, h, w = planes.shape
    axes = [w, h] if n == 1 and not len(rest) else [w, h, n]
    if not planes.size and not rest.size:
        axes = []
    cards = [card("SIMPLE", True), card("BITPIX", bitpix), card("NAXIS", len(axes)), *(card(f"NAXIS{i}", a) for i, a in enumerate(axes, 1))]
    yield header(cards + calibration + more)
    yield from _samples(planes, bitpix)
    if rest.size:
        cards = [card("XTENSION", "IMAGE"), card("BITPIX", bitpix), card("NAXIS", 2), card("NAXIS1", w), card("NAXIS2", len(rest)), card("PCOUNT", 0), card("GCOUNT", 1)]
        yield header([*cards, card(LAST_PLANE, True, "rows of the next plane, which isn't full"), *calibration])
        yield from _samples(rest[None], bitpix)


def _samples(planes: np.ndarray, bitpix: int) -> Iterator[bytes]:
    for p in planes:
        yield p.astype(BITPIX[bitpix][1]).tobytes()
    size = planes.size * BITPIX[bitpix][0]
    yield b"\0" * (padded(size) - size)


def _placed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plane, y, x and sample of each of a batch's samples."""
    plane, y = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("plane", "y"))
    raw = b.column("raw")
    if not pa.types.is_list(raw.type):
        return plane, y, b.column("x").to_numpy(zero_copy_only=False).astype(np.int64), raw.to_numpy(zero_copy_only=False)
    size = pc.list_value_length(raw)
    w = pc.max(size).as_py() or 0
    if raw.null_count or pc.min(size).as_py() != w:
        raise ValueError("rows of samples of different lengths")
    return np.repeat(plane, w), np.repeat(y, w), np.tile(np.arange(w), len(plane)), raw.flatten().to_numpy(zero_copy_only=False)


def stack(held: Aside, height: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(plane, y, x, raw) or (plane, y, raw list) rows to an array of whole planes and the rows of a last one that isn't full.

    Only with a height the last plane may have fewer rows.
    """
    n = high = w = last = many = 0
    for plane, y, x, flat in (_placed(b) for b in held.again()):
        if not len(flat):
            continue
        if plane.max() >= n:
            n, last = int(plane.max()) + 1, 0
        last = max(last, int(y[plane == n - 1].max(initial=-1)) + 1)
        high, w, many = max(high, int(y.max()) + 1), max(w, int(x.max()) + 1), many + len(flat)
    if not many:
        return np.zeros((0, 0, 0)), np.zeros((0, 0))
    h = height or high
    if high > h:
        raise ValueError(f"row {high - 1} of planes of {h} rows")
    if many != ((n - 1) * h + (last if height else h)) * w:
        raise ValueError(f"{many} samples don't fill {n} planes of {w} by {h}")
    kind = held.schema["raw"].dataType
    out = np.zeros((n, h, w), np.dtype(_NUMPY[TYPES[(kind.elementType if isinstance(kind, T.ArrayType) else kind).simpleString()]]).newbyteorder("="))
    for plane, y, x, flat in (_placed(b) for b in held.again()):
        out[plane, y, x] = flat
    return (out, out[0, :0]) if last == h else (out[: n - 1], out[n - 1, :last])


@dataclass
class Written(WriterCommitMessage):
    """A task's file; of a single file's rows also their partition, number and extents."""

    name: str | None
    rows: int
    part: int = 0
    extents: list[Extent] | None = None


def _widened(data: bytes, own: list[str], forms: list[str]) -> bytes:
    """Rows of some formats in those of the same columns with text as wide or wider."""
    block = np.frombuffer(data, np.uint8).reshape(-1, sum(map(width, own)))
    out = np.full((len(block), sum(map(width, forms))), 32, np.uint8)
    a = b = 0
    for x, y in zip(map(width, own), map(width, forms)):
        out[:, b : b + x] = block[:, a : a + x]
        a, b = a + x, b + y
    return out.tobytes()


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, options: dict, overwrite: bool):
        self.path, self.wanted, self.options, self.overwrite = path, schema, options, overwrite
        self.single = str(options.get("single", "false")).lower() == "true" and options.get("kind", "table") == "table"
        self.job = uuid.uuid4().hex
        for f in schema.fields:
            if (options.get("kind", "table") == "table") and not isinstance(f.dataType, (T.ArrayType, T.TimestampType, T.TimestampNTZType)) and f.dataType.simpleString() not in TYPES:
                raise ValueError(f"column {f.name}: {f.dataType.simpleString()} can't be written; cast it")
        fs, inner = file_system(path)
        self.old = [f.path for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.type == pafs.FileType.File] if overwrite else []

    def _staging(self, inner: str) -> str:
        return f"{inner.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        batches, o, at = chain([first], iterator), self.options, TaskContext.get()
        more, part, extents = more_cards(o.get("header", "")), at.partitionId(), None
        fs, inner = file_system(self.path)
        fs.create_dir(self._staging(inner), recursive=True)
        name = f"part-{part:05d}-{at.taskAttemptId()}.fits"
        with Aside(self.wanted) as held, fs.open_output_stream(f"{self._staging(inner)}/{name}") as out:
            if o.get("kind", "table") == "image":
                kind = self.wanted["raw"].dataType
                kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
                calibration = [card(k, float(o[n])) for k, n in (("BZERO", "bzero"), ("BSCALE", "bscale")) if n in o] + ([card("BAYERPAT", o["bayer"])] if "bayer" in o else [])
                held.take(batches)
                rows, chunks = held.rows, image_bytes(*stack(held, int(o["height"]) if "height" in o else None), more, int(o.get("bitpix", _BITPIX_OF[kind.simpleString()])), calibration)
            else:
                held.take(batches)
                rows, forms = held.rows, held.forms()
                chunks = table_rows(held.again(), self.wanted, forms)
                if self.single:
                    extents = held.extents
                else:
                    chunks = chain([table_head(self.wanted, forms, rows, o.get("extname"), more)], chunks, [table_end(forms, rows)])
            for c in chunks:
                out.write(c)
        return Written(name, rows, part, extents)

    def _join(self, messages: list[Written], fs: pafs.FileSystem, staging: str) -> str:
        """One file of the tasks' rows in the order of partitions; rows of narrower text are made as wide as the widest."""
        messages = sorted(messages, key=lambda m: m.part)
        rows, name = sum(m.rows for m in messages), f"part-00000-{self.job}.fits"
        form = lambda extents: [x.form(f.dataType) for x, f in zip(extents, self.wanted.fields)]
        forms = form([reduce(or_, x) for x in zip(*(m.extents for m in messages))])
        with fs.open_output_stream(f"{staging}/{name}") as out:
            out.write(table_head(self.wanted, forms, rows, self.options.get("extname"), more_cards(self.options.get("header", ""))))
            for m in messages:
                own = form(m.extents)
                stride = sum(map(width, own))
                size, step = m.rows * stride, max(1, BATCH_BYTES // max(1, stride)) * stride
                with fs.open_input_file(f"{staging}/{m.name}") as f:
                    for a in range(0, size, max(1, step)):
                        data = f.read_at(min(step, size - a), a)
                        out.write(data if own == forms else _widened(data, own, forms))
            out.write(table_end(forms, rows))
        return name

    def commit(self, messages: list[Written | None]) -> None:
        """New files come before old ones go, so a failure between loses neither; a table without rows is one file."""
        fs, inner = file_system(self.path)
        fs.create_dir(inner, recursive=True)
        written = [m for m in messages if m is not None and m.name]
        names = [self._join(written, fs, self._staging(inner))] if self.single and written else [m.name for m in written]
        if not names and self.options.get("kind", "table") == "table":
            fs.create_dir(self._staging(inner), recursive=True)
            names = [f"part-00000-{self.job}.fits"]
            with fs.open_output_stream(f"{self._staging(inner)}/{names[0]}") as out:
                for c in table_bytes([], self.wanted, self.options.get("extname"), more_cards(self.options.get("header", ""))):
                    out.write(c)
        made = {f"{inner.rstrip('/')}/{n}" for n in names}
        for n in names:
            fs.move(f"{self._staging(inner)}/{n}", f"{inner.rstrip('/')}/{n}")
        for old in self.old:
            if old not in made:
                fs.delete_file(old)
        self._clear(fs, inner)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, inner: str) -> None:
        if fs.get_file_info(self._staging(inner)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(inner))
