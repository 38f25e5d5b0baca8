"""The Spark data source: ``spark.read.format("starfile")`` with one relation a call.

Options: ``relation`` (hdus, cards, table, image, ascii; default table), ``hdu`` (index or EXTNAME;
default the first unit of the relation's kind), ``mode`` (standard, reference), ``parse``
(PERMISSIVE: a file without such a unit gives no rows, hdus and cards tell a broken header's error,
broken data are an error; DROPMALFORMED: a file gives what it has up to the break; FAILFAST: all of
these are errors), ``scaling`` and ``nulls`` (apply TSCAL and TZERO, TNULL), ``arrays`` (a list even for one
value a cell), ``meta`` (adds _path, _hdu, _row), ``layout`` of images (pixels, rows,
pairs of rows), ``plane`` (the only one that is read), ``partitionBytes``, ``recursive``, ``pushdown``.

Planning lists files and reads the headers of the first one, for the schema (where rows are addressed,
of each file of several tasks, whose other ranges get no task); every task reads the headers of its own files. Files are cut into ranges of rows by size, and small files share a task.
A schema given by the reader selects the columns that are decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..layout import ASCII_TYPES, BITPIX, MODES, Field, ascii_fields, padded, table_fields
from . import decode
from .headers import FormatError, Unit, last_plane, pick, units
from .storage import list_files, open_bytes, open_file

PARTITION_BYTES = 64 << 20
#: Of pixels, each of which becomes a row of some 64 bytes.
PIXEL_PARTITION_BYTES = 4 << 20
PIXEL_BYTES = 64
#: A small file counts as so many bytes at least where files share a task.
OPEN_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
#: An end of rows that no file reaches.
EVERY = 2**62

META = (T.StructField("_path", T.StringType()), T.StructField("_hdu", T.IntegerType()), T.StructField("_row", T.LongType()))

HDU_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("path", T.StringType()), ("hdu_index", T.IntegerType()), ("kind", T.StringType()), ("extname", T.StringType()),
        ("header_offset", T.LongType()), ("header_bytes", T.LongType()), ("n_cards", T.IntegerType()), ("data_offset", T.LongType()), ("data_bytes", T.LongType()), ("padded_bytes", T.LongType()),
        ("bitpix", T.IntegerType()), ("naxis", T.IntegerType()), ("axes", T.ArrayType(T.LongType())), ("pcount", T.LongType()), ("gcount", T.LongType()),
        ("n_rows", T.LongType()), ("row_bytes", T.LongType()), ("n_fields", T.IntegerType()), ("table_bytes", T.LongType()),
        ("width", T.LongType()), ("height", T.LongType()), ("n_planes", T.LongType()), ("plane_bytes", T.LongType()),
        ("bzero", T.DoubleType()), ("bscale", T.DoubleType()), ("bayer_pattern", T.StringType()), ("image_type", T.StringType()), ("exposure_seconds", T.DoubleType()), ("error", T.StringType()),
    )]
)
CARD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("hdu_index", T.IntegerType()), ("card_index", T.IntegerType()), ("card", T.StringType()), ("error", T.StringType()))])


@dataclass(frozen=True)
class Settings:
    relation: str = "table"
    hdu: str | None = None
    mode: str = "standard"
    failfast: bool = False
    drop: bool = False
    scaling: bool = False
    nulls: bool = False
    arrays: bool = False
    meta: bool = False
    layout: str = "pixels"
    partition_bytes: int = PARTITION_BYTES
    plane: int | None = None

    @staticmethod
    def of(options) -> Settings:
        get = lambda k, d: str(options.get(k, d))
        yes = lambda k: get(k, "false").lower() == "true"
        relation, mode, parse, layout = get("relation", "table"), get("mode", "standard"), get("parse", "PERMISSIVE").upper(), get("layout", "pixels")
        for name, value, known in (("relation", relation, ("hdus", "cards", "table", "image", "ascii")), ("mode", mode, MODES), ("parse", parse, ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")), ("layout", layout, ("pixels", "rows", "pairs"))):
            if value not in known:
                raise ValueError(f"option {name}: {value!r} is none of {', '.join(known)}")
        return Settings(relation, options.get("hdu"), mode, parse == "FAILFAST", parse == "DROPMALFORMED", yes("scaling"), yes("nulls"), yes("arrays"), yes("meta"), layout, int(get("partitionBytes", PIXEL_PARTITION_BYTES if relation == "image" and layout == "pixels" else PARTITION_BYTES)), int(options["plane"]) if options.get("plane") is not None else None)

    @property
    def pixels(self) -> bool:
        return self.relation == "image" and self.layout == "pixels"

    @property
    def kinds(self) -> tuple[str, ...]:
        return {"table": ("BINTABLE",), "ascii": ("TABLE",), "image": ("IMAGE",)}[self.relation]


def image_fields(bitpix: int, s: Settings) -> list[T.StructField]:
    raw = BITPIX[bitpix][2]
    own = [T.StructField("plane", T.LongType()), T.StructField("y", T.LongType())]
    if s.layout == "pixels":
        own += [T.StructField("x", T.LongType()), T.StructField("raw", raw)]
    else:
        own += [T.StructField(n, T.ArrayType(raw)) for n in (("raw",) if s.layout == "rows" else ("even", "odd"))]
    kinds = (("bitpix", T.IntegerType()), ("bzero", T.DoubleType()), ("bscale", T.DoubleType()), ("width", T.LongType()), ("height", T.LongType()), ("bayer_pattern", T.StringType()))
    return own + [T.StructField(n, t) for n, t in kinds]


def schema_of(unit: Unit, s: Settings) -> T.StructType:
    if s.relation == "image":
        fields = image_fields(unit.bitpix or 8, s)
    elif s.relation == "ascii":
        fields = [T.StructField(f.name, T.DoubleType() if s.scaling and f.text != "A" else ASCII_TYPES[f.text]) for f in ascii_fields(unit.first)]
    else:
        fields = [T.StructField(f.name, f.spark_type(s.scaling, s.arrays)) for f in table_fields(unit.first, s.mode)]
    return T.StructType(fields + (list(META) if s.meta else []))


def hdu_row(path: str, u: Unit) -> tuple:
    w, h, planes = u.plane
    table = u.kind in ("TABLE", "BINTABLE")
    axes = u.axes
    size = BITPIX[u.bitpix][0] if u.bitpix is not None else 0
    text = lambda k: v.strip() if isinstance(v := u.first.get(k), str) else None
    num = lambda k, d=None: float(v) if isinstance(v := u.first.get(k), (int, float)) and not isinstance(v, bool) else d
    bayer = text("BAYERPAT")
    exposure = num("EXPOSURE", num("EXPTIME"))
    return (
        path, u.index, u.kind, u.name, u.offset, u.header_bytes, len(u.cards), u.data_offset, u.data_bytes, padded(u.data_bytes),
        u.bitpix, len(axes), axes, int(num("PCOUNT", 0)), int(num("GCOUNT", 1)),
        axes[1] if table and len(axes) > 1 else None, axes[0] if table and axes else None, int(num("TFIELDS", 0)) if table else None, axes[0] * axes[1] if table and len(axes) > 1 else None,
        w, h, planes, w * h * size, num("BZERO", 0.0), num("BSCALE", 1.0), bayer.upper() if bayer else None, text("IMAGETYP"), exposure, None,
    )


def _batches(rows: Iterator[tuple], schema: T.StructType, n: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    for r in rows:
        held.append(r)
        if len(held) >= n:
            yield out()
            held = []
    if held:
        yield out()


def _headers(path: str, file, s: Settings) -> Iterator[tuple]:
    seen = -1
    try:
        for u in units(file):
            seen = u.index
            if s.relation == "hdus":
                yield hdu_row(path, u)
            else:
                for i, card in enumerate(u.cards):
                    yield path, u.index, i, card, None
    except (FormatError, ValueError) as e:
        if s.failfast:
            raise
        yield (path, seen + 1, *[None] * (len(HDU_SCHEMA if s.relation == "hdus" else CARD_SCHEMA) - 3), str(e))


def data_batches(path: str, file, part: int, parts: int, schema: T.StructType, s: Settings, span: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The part-th of parts ranges of rows of a table or an image, as Arrow batches of the schema."""
    u = pick(file, s.hdu, s.kinds)
    if u is None:
        if s.failfast:
            raise FormatError(f"{path}: no {s.relation} at {s.hdu if s.hdu is not None else 'any unit'}")
        return
    if s.relation == "image":
        yield from _image_batches(path, file, u, part, parts, schema, s, span)
        return
    if len(u.axes) != 2:
        raise FormatError(f"{path}: unit {u.index}: a table has two axes, this one has {len(u.axes)}")
    stride, total = u.axes
    fields = _fields(path, u, schema, s)
    first, stop = total * part // parts, total * (part + 1) // parts
    if span:
        first, stop = max(first, span[0]), min(stop, span[1])
    step = max(1, BATCH_BYTES // max(1, stride))
    heap_at = u.data_offset + int(u.first.get("THEAP") or stride * total)
    for a in range(first, stop, step):
        b = min(stop, a + step)
        block = _rows(path, file, u, a, b, a * stride, stride)
        yield _table_batch(u, fields, block, lambda: pa.array([path] * (b - a), pa.string()), lambda: np.arange(a, b), schema, s, lambda o, n: file.at(heap_at + o, n))


def _fields(path: str, u: Unit, schema: T.StructType, s: Settings) -> dict[str, Field]:
    """A table's columns by lower-case name; those of the schema must be there."""
    fields = {f.name.lower(): f for f in (table_fields(u.first, s.mode) if s.relation == "table" else ascii_fields(u.first))}
    for f in schema.fields:
        if f.name.lower() not in fields and f.name not in ("_path", "_hdu", "_row"):
            raise FormatError(f"{path}: unit {u.index} has no column {f.name}")
    return fields


def _table_batch(u: Unit, fields: dict[str, Field], block: np.ndarray, paths, ordinals, schema: T.StructType, s: Settings, heap) -> pa.RecordBatch:
    """A block of a table's rows; paths and ordinals make what _path and _row are to have."""
    n = len(block)
    meta = {"_path": paths, "_hdu": lambda: pa.array(np.full(n, u.index, np.int32)), "_row": lambda: pa.array(ordinals())}
    cols = []
    for f in schema.fields:
        if f.name in meta:
            cols.append(meta[f.name]())
        elif s.relation == "ascii":
            cols.append(decode.ascii_column(block, fields[f.name.lower()], f.dataType, s.scaling))
        else:
            cols.append(decode.column(block, fields[f.name.lower()], f.dataType, s.mode, s.scaling, s.nulls, heap))
    return pa.RecordBatch.from_arrays(cols, schema=to_arrow_schema(schema)) if cols else pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))


def extent(file, u: Unit, s: Settings) -> tuple[int, int]:
    """The first row (or pair of rows) that is asked for and the number of them, before a range of rows is chosen."""
    if s.relation != "image":
        return 0, u.axes[1] if len(u.axes) == 2 else 0
    _, h, planes = u.plane
    each = 2 if s.layout == "pairs" else 1
    rest = last_plane(file, u)
    high, more = h // each, rest.plane[1] // each if rest else 0
    if s.plane is not None:  # a plane is a range of rows, the only one that is read
        return s.plane * high, high if 0 <= s.plane < planes else more if s.plane == planes else 0
    return 0, high * planes + more


def _rows(path: str, file, u: Unit, a: int, b: int, at: int, stride: int) -> np.ndarray:
    """Rows a to b of a unit, which begin at a byte of its data."""
    data = file.at(u.data_offset + at, (b - a) * stride)
    if len(data) < (b - a) * stride:
        raise FormatError(f"{path}: unit {u.index} ends early: rows {a} to {b} need {(b - a) * stride} bytes, {len(data)} are there")
    return np.frombuffer(data, np.uint8).reshape(b - a, stride)


def _image_batches(path: str, file, u: Unit, part: int, parts: int, schema: T.StructType, s: Settings, span: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Rows (or pairs of rows) of an image are numbered through its planes; those of a last plane that isn't full are in the unit after it."""
    w, h, planes = u.plane
    if u.bitpix is None:
        raise FormatError(f"{path}: unit {u.index}: BITPIX is invalid")
    line = w * BITPIX[u.bitpix][0]
    each, high = (2, h // 2) if s.layout == "pairs" else (1, h)
    total, stride, arrow = high * planes, each * line, to_arrow_schema(schema)
    rest = last_plane(file, u)
    more = rest.plane[1] // each if rest else 0
    base, many = extent(file, u, s)
    first, stop = base + many * part // parts, base + many * (part + 1) // parts
    if span:
        first, stop = max(first, span[0]), min(stop, span[1])
    apart = s.layout == "pairs" and h % 2 and planes > 1  # planes apart: a pair's place isn't its number times its size
    step = max(1, BATCH_BYTES // max(1, w * PIXEL_BYTES if s.pixels else stride))
    for unit, low, end, step in ((u, 0, total, 1 if apart else step), *([(rest, total, total + more, step)] if rest else [])):
        for a in range(max(first, low), min(stop, end), step):
            b = min(stop, end, a + step)
            at = (a // high * h + a % high * 2) * line if apart and unit is u else (a - low) * stride
            yield _image_batch(path, unit, high, _rows(path, file, unit, a - low, b - low, at, stride), a, arrow, schema, s)


def _image_batch(path: str, u: Unit, high: int, block: np.ndarray, first: int, arrow: pa.Schema, schema: T.StructType, s: Settings) -> pa.RecordBatch:
    w, h, _ = u.plane
    rows = np.arange(first, first + len(block))
    pairs = s.layout == "pairs"
    each = w if s.layout == "pixels" else 1
    n = len(block) * each
    num = lambda k, d: float(v) if isinstance(v := u.first.get(k), (int, float)) else d
    bayer = u.first.get("BAYERPAT")
    made = {
        "plane": lambda: pa.array(np.repeat(rows // high, each)),
        "y": lambda: pa.array(np.repeat(rows % high, each)),
        "x": lambda: pa.array(np.tile(np.arange(w), len(block))),
        "bitpix": lambda: pa.array(np.full(n, u.bitpix, np.int32)),
        "bzero": lambda: pa.array(np.full(n, num("BZERO", 0.0))),
        "bscale": lambda: pa.array(np.full(n, num("BSCALE", 1.0))),
        "width": lambda: pa.array(np.full(n, w)),
        "height": lambda: pa.array(np.full(n, h)),
        "bayer_pattern": lambda: pa.array([bayer.strip().upper() if isinstance(bayer, str) else None] * n, pa.string()),
        "_path": lambda: pa.array([path] * n),
        "_hdu": lambda: pa.array(np.full(n, u.index, np.int32)),
        "_row": lambda: pa.array(np.repeat(rows, each)),
    }

    def raw(kind: pa.DataType, part: str) -> pa.Array:
        x = np.ascontiguousarray(block).view(BITPIX[u.bitpix][1])
        x = (x[:, :w] if part == "even" else x[:, w:]).ravel() if pairs else x.ravel()
        flat = pa.array(x.astype(x.dtype.newbyteorder("=")))
        if s.layout != "pixels":
            return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * w), flat.cast(kind.value_type))
        return flat.cast(kind)

    cols = [raw(arrow.field(i).type, f.name) if f.name in ("raw", "even", "odd") else made[f.name]().cast(arrow.field(i).type) for i, f in enumerate(schema.fields)]
    return pa.RecordBatch.from_arrays(cols, schema=arrow)


@dataclass
class Ranges(InputPartition):
    """(path, part, parts) of the files of one task."""

    pieces: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, s: Settings, recursive: bool):
        self.path, self.want, self.s, self.recursive = path, schema, s, recursive
        self.low, self.high, self.paths = 0, EVERY, None

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        room, least = 0, OPEN_BYTES * min(self.s.partition_bytes, PARTITION_BYTES) // PARTITION_BYTES if self.s.pixels else OPEN_BYTES
        for path, size in list_files(self.path, self.recursive):
            if self.paths is not None and path not in self.paths:
                continue
            parts = 1 if path.endswith(".gz") or self.s.relation in ("hdus", "cards") else max(1, -(-size // self.s.partition_bytes))
            cost = OPEN_BYTES if self.s.relation in ("hdus", "cards") else max(size, least)
            if parts > 1:
                out += [Ranges([(path, k, parts)]) for k in self._asked(path, parts)]
                room = 0
            elif room >= cost:
                out[-1].pieces.append((path, 0, 1))
                room -= cost
            else:
                out.append(Ranges([(path, 0, 1)]))
                room = max(0, self.s.partition_bytes - cost)
        return out or [Ranges([])]

    def _asked(self, path: str, parts: int) -> Iterable[int]:
        """The parts of a file that have rows asked for; where rows are addressed, its header tells."""
        if self.low <= 0 and self.high >= EVERY:
            return range(parts)
        file = open_file(path)
        try:
            u = pick(file, self.s.hdu, self.s.kinds)
            base, many = extent(file, u, self.s) if u is not None else (0, 0)
        except (FormatError, ValueError):  # the task that reads the file tells it
            return range(parts)
        finally:
            file.close()
        low, high = max(self.low - base, 0), min(self.high - base, many)
        if u is None or not many:
            return range(1)
        near = range(max(0, low * parts // many - 1), min(parts, high * parts // many + 2))
        return [k for k in near if many * k // parts < high and many * (k + 1) // parts > low]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, part, parts in partition.pieces:
            file = open_file(path)
            try:
                if self.s.relation in ("hdus", "cards"):
                    full = HDU_SCHEMA if self.s.relation == "hdus" else CARD_SCHEMA
                    for batch in _batches(_headers(path, file, self.s), full):
                        yield batch.select([f.name for f in self.want.fields])
                else:
                    try:
                        yield from data_batches(path, file, part, parts, self.want, self.s, (self.low, self.high))
                    except FormatError:
                        if not self.s.drop:
                            raise
            finally:
                file.close()


class PushdownReader(Reader):
    """Takes conditions on _row and _path into the plan: rows are addressed, other files not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = f.attribute, getattr(f, "value", None)
            if name == ("_row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, value + 1)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, value)
            elif name == ("_path",) and isinstance(f, (EqualTo, In)):
                chosen = {value} if isinstance(f, EqualTo) else set(value)
                self.paths = chosen if self.paths is None else self.paths & chosen
            else:
                yield f


class StarFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "starfile"

    @property
    def settings(self) -> Settings:
        return Settings.of(self.options)

    def schema(self) -> T.StructType:
        s = self.settings
        if s.relation in ("hdus", "cards"):
            return HDU_SCHEMA if s.relation == "hdus" else CARD_SCHEMA
        error = None
        for path, _ in list_files(self.options["path"], self._recursive):
            file = open_file(path)
            try:
                if (u := pick(file, s.hdu, s.kinds)) is not None:
                    return schema_of(u, s)
            except (FormatError, ValueError) as e:
                error = e
                if s.failfast:
                    raise
            finally:
                file.close()
        if s.relation == "image":
            return T.StructType(image_fields(8, s) + (list(META) if s.meta else []))
        raise error or FormatError(f"{self.options['path']}: no file with a {s.relation}")

    @property
    def _recursive(self) -> bool:
        return str(self.options.get("recursive", "false")).lower() == "true"

    def reader(self, schema: T.StructType) -> Reader:
        kind = PushdownReader if str(self.options.get("pushdown", "false")).lower() == "true" else Reader
        return kind(self.options["path"], schema, self.settings, self._recursive)

    def writer(self, schema: T.StructType, overwrite: bool):
        from .writer import Writer

        return Writer(self.options["path"], schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make ``starfile`` known to a session."""
    spark.dataSource.register(StarFile)
    return spark


def decode_bytes(batches: Iterator[pa.RecordBatch], schema: T.StructType, s: Settings) -> Iterator[pa.RecordBatch]:
    """(path, content) rows, each a whole file in memory, to the relation's rows.

    Tables of files in a row with one and the same header are decoded together.
    """
    alike = None
    for b in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):  # Python's copies of few files at a time
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if content is None:
                continue
            file = open_bytes(content, path)
            if s.relation in ("hdus", "cards"):
                yield from _batches(_headers(path, file, s), schema)
                continue
            if alike is not None and not alike.takes(file):
                yield from alike.batches(schema, s)
                alike = None
            if alike is None and (alike := Alike.of(file, schema, s)) is None:
                yield from _one_file(path, file, schema, s)
                continue
            if alike.add(path, file):
                yield from alike.batches(schema, s)
    if alike is not None:
        yield from alike.batches(schema, s)


def _one_file(path: str, file, schema: T.StructType, s: Settings) -> Iterator[pa.RecordBatch]:
    try:
        yield from data_batches(path, file, 0, 1, schema, s)
    except FormatError:
        if not s.drop:
            raise


class Alike:
    """Files in memory whose bytes up to a table's data are the same: one header is parsed, and small tables are one block."""

    def __init__(self, unit: Unit, fields: dict[str, Field], head: bytes):
        self.unit, self.fields, self.head = unit, fields, head
        self.total, self.stride = unit.axes[1], unit.axes[0]
        self.size, self.files, self.held = self.total * self.stride, [], 0

    @staticmethod
    def of(file, schema: T.StructType, s: Settings) -> Alike | None:
        """None for what is decoded by itself: images, broken headers, tables without rows or of more than a batch, cells in a heap."""
        if s.relation == "image":
            return None
        try:
            u = pick(file, s.hdu, s.kinds)
            if u is None or len(u.axes) != 2 or not 0 < u.axes[0] * u.axes[1] <= BATCH_BYTES:
                return None
            fields = _fields(file.name, u, schema, s)
        except ValueError:
            return None
        if any(f.name.lower() in fields and fields[f.name.lower()].format.letter in "PQ" for f in schema.fields):
            return None
        return Alike(u, fields, file.at(0, u.data_offset))

    def takes(self, file) -> bool:
        return file.data.startswith(self.head)

    def add(self, path: str, file) -> bool:
        """Whether a batch is there."""
        self.files.append((path, file))
        self.held += file.size
        return self.held >= BATCH_BYTES

    def batches(self, schema: T.StructType, s: Settings) -> Iterator[pa.RecordBatch]:
        files, self.files, self.held = self.files, [], 0
        if not files:
            return
        u, at = self.unit, self.unit.data_offset
        data = [file.data[at : at + self.size] for _, file in files]
        try:
            if any(len(x) < self.size for x in data):
                raise FormatError("a table ends early")
            block = np.frombuffer(b"".join(data), np.uint8).reshape(len(files) * self.total, self.stride)
            out = _table_batch(u, self.fields, block, lambda: pa.array([p for p, _ in files for _ in range(self.total)], pa.string()), lambda: np.tile(np.arange(self.total), len(files)), schema, s, None)
        except FormatError:  # the file that breaks the format tells it, or is what is dropped
            for path, file in files:
                yield from _one_file(path, file, schema, s)
            return
        yield out
