"""Python data sources for point clouds: pcd, labels, las, cloudbin, plyvertex.

Files of fixed-size records are split by row ranges. Register all of them with
``register_sources(spark)``.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from canopyframe.sources.files import (BATCH_ROWS, PartWriter, RowRange, box, list_files, merge_boxes, open_read,
                                       row_ranges, tile_name, to_numpy)

POINT_SCHEMA = "tile_id string, point_idx bigint, x double, y double, z double, r smallint, g smallint, b smallint"
_POINT_ARROW = pa.schema([("tile_id", pa.string()), ("point_idx", pa.int64()), ("x", pa.float64()), ("y", pa.float64()),
                          ("z", pa.float64()), ("r", pa.int16()), ("g", pa.int16()), ("b", pa.int16())])


def _point_batch(tile: str, start: int, xyz, rgb) -> pa.RecordBatch:
    n = len(xyz[0])
    cols = [pa.array([tile] * n), pa.array(np.arange(start, start + n)), *[pa.array(np.asarray(c, np.float64)) for c in xyz]]
    cols += [pa.array(np.asarray(c, np.int16)) for c in rgb] if rgb is not None else [pa.nulls(n, pa.int16())] * 3
    return pa.record_batch(cols, schema=_POINT_ARROW)


# ---- PCD ----------------------------------------------------------------------------

# fixed values: field type and size -> element type
_PCD_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4", ("I", 8): "<i8",
              ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("U", 8): "<u8"}


def pcd_header(path: str) -> dict:
    """Field layout, row count, data format and start of the data."""
    head: dict = {}
    with open_read(path) as f:
        raw = f.read(65_536)
    at = 0
    while "DATA" not in head:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"incomplete PCD header in {path}")
        key, _, value = raw[at:end].decode("ascii", "replace").strip().partition(" ")
        at = end + 1
        if key and not key.startswith("#"):
            head[key.upper()] = value.split()
    fields = head["FIELDS"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(fields))]
    names, kinds = [], []
    for name, size, kind, count in zip(fields, head["SIZE"], head["TYPE"], counts):
        element = _PCD_TYPES.get((kind.upper(), int(size)))
        if element is None:
            raise ValueError(f"unsupported PCD field type {kind}{size}")
        for k in range(count):
            names.append(name if count == 1 else f"{name}_{k}")
            kinds.append(element)
    rows = head.get("POINTS") or head.get("WIDTH")
    if rows is None:
        raise ValueError(f"PCD without POINTS or WIDTH: {path}")
    fmt = head["DATA"][0].lower()
    if fmt not in ("ascii", "binary"):
        raise ValueError(f"PCD data format {fmt} is not supported")
    return {"dtype": np.dtype(list(zip(names, kinds))), "rows": int(rows[0]), "format": fmt, "start": at}


def _unpack_rgb(values) -> tuple:
    bits = np.ascontiguousarray(values).view(np.uint32) if values.dtype == np.float32 else values.astype(np.uint32)
    return (bits >> 16) & 255, (bits >> 8) & 255, bits & 255


class PcdReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        parts = []
        for path, _ in list_files(self.path, (".pcd",)):
            head = pcd_header(path)
            if head["format"] == "binary":
                parts += row_ranges(path, head["rows"], head["dtype"].itemsize)
            else:
                parts.append(RowRange(path, 0, head["rows"]))
        return parts

    def read(self, part: RowRange):
        head = pcd_header(part.path)
        dtype, names = head["dtype"], head["dtype"].names
        colour = next((n for n in ("rgb", "rgba") if n in names), None)
        with open_read(part.path) as f:
            if head["format"] == "binary":
                f.seek(head["start"] + part.start * dtype.itemsize)
                for lo, hi in part.steps():
                    rows = np.frombuffer(f.read((hi - lo) * dtype.itemsize), dtype=dtype)
                    yield self._batch(part.path, lo, rows, colour)
            else:
                f.seek(head["start"])
                at = 0
                for lines in _line_batches(f):
                    table = np.array([ln.split() for ln in lines if ln.strip()], dtype=np.float64).reshape(-1, len(names))
                    rows = {n: table[:, i].astype(np.float32) if n in "xyz" else table[:, i] for i, n in enumerate(names)}
                    yield self._batch(part.path, at, rows, colour)
                    at += len(table)

    @staticmethod
    def _batch(path, start, rows, colour):
        xyz = [np.asarray(rows[a], np.float32) for a in "xyz"]
        return _point_batch(tile_name(path), start, xyz, _unpack_rgb(np.asarray(rows[colour])) if colour else None)


def _line_batches(f):
    """Complete text lines in batches."""
    rest = b""
    while chunk := f.read(4 << 20):
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop()
        for lo in range(0, len(lines), BATCH_ROWS):
            yield lines[lo:lo + BATCH_ROWS]
    if rest.strip():
        yield [rest]


class PcdSource(DataSource):
    """``spark.read.format("pcd").load(path)``: x, y, z in single precision, optional colour; a text file is one task (see ``lines.read_pcd_text``)."""

    @classmethod
    def name(cls):
        return "pcd"

    def schema(self):
        return POINT_SCHEMA

    def reader(self, schema):
        return PcdReader(self.options)


class LabelReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [RowRange(path, 0, 0) for path, _ in list_files(self.path, (".labels", ".txt"))]

    def read(self, part):
        at = 0
        with open_read(part.path) as f:
            for lines in _line_batches(f):
                values = np.array([int(float(ln)) for ln in lines if ln.strip()], dtype=np.int64)
                n = len(values)
                yield pa.record_batch([pa.array([tile_name(part.path)] * n), pa.array(np.arange(at, at + n)), pa.array(values)],
                                      names=["tile_id", "point_idx", "label"])
                at += n


class LabelSource(DataSource):
    """One integer per line, aligned with the rows of the cloud of the same name; a file is one task (see ``lines.read_point_labels``)."""

    @classmethod
    def name(cls):
        return "pointlabels"

    def schema(self):
        return "tile_id string, point_idx bigint, label bigint"

    def reader(self, schema):
        return LabelReader(self.options)


def attach_labels(points, labels):
    """Points with their label; raises if a tile has points without label or the reverse."""
    # both number their rows without gaps, so equal numbers of rows are equal rows
    ours, theirs = (df.groupBy("tile_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((points, "_p"), (labels, "_l")))
    odd = ours.join(theirs, "tile_id", "full_outer").where("_p is null or _l is null or _p <> _l").take(1)
    if odd:
        raise ValueError(f"points and labels differ in number in tile {odd[0]['tile_id']}")
    return points.join(labels, ["tile_id", "point_idx"])


# ---- LAS -----------------------------------------------------------------------------

# fixed values: byte offsets per point format (class, point source id, red or None)
_LAS_LAYOUT = {0: (15, 18, None), 1: (15, 18, None), 2: (15, 18, 20), 3: (15, 18, 28), 6: (16, 20, None), 7: (16, 20, 30), 8: (16, 20, 30)}
LAS_SCHEMA = ("tile_id string, point_idx bigint, x double, y double, z double, intensity int, class smallint, "
              "source_id int, red int, green int, blue int")


def las_header(path: str) -> dict:
    with open_read(path) as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    start, = struct.unpack_from("<I", raw, 96)
    fmt, size, rows = struct.unpack_from("<BHI", raw, 104)
    if fmt & 0x80 or fmt not in _LAS_LAYOUT:
        raise ValueError(f"LAS point format {fmt} is not supported: {path}")
    if raw[25] >= 4:
        rows = struct.unpack_from("<Q", raw, 247)[0] or rows
    ends = struct.unpack_from("<6d", raw, 179)
    return {"start": start, "format": fmt, "size": size, "rows": rows, "scale": struct.unpack_from("<3d", raw, 131),
            "offset": struct.unpack_from("<3d", raw, 155), "max": ends[0::2], "min": ends[1::2]}


class LasReader(DataSourceReader):
    """Options ``window`` (xmin,ymin,xmax,ymax), ``zrange`` (low,high) and ``classes`` restrict the rows.

    They are options and not pushed filters because Spark keeps pushed filters of
    a Python source with the relation, so that a second query on the same frame
    would see the rows of the first.
    """

    def __init__(self, options):
        self.path = options["path"]
        numbers = lambda key: [float(v) for v in options[key].split(",")] if key in options else None
        window, zrange, classes = numbers("window"), numbers("zrange"), numbers("classes")
        self.ranges = {"x": (window[0], window[2]), "y": (window[1], window[3])} if window else {}
        if zrange:
            self.ranges["z"] = (zrange[0], zrange[1])
        self.classes = [int(c) for c in classes] if classes else None

    def partitions(self):
        parts = []
        for path, _ in list_files(self.path, (".las",)):
            head = las_header(path)
            if all(head["max"]["xyz".index(a)] >= lo and head["min"]["xyz".index(a)] <= hi for a, (lo, hi) in self.ranges.items()):
                parts += row_ranges(path, head["rows"], head["size"])
        return parts or [RowRange(self.path, 0, 0)]

    def read(self, part):
        if part.start == part.stop:
            return
        head = las_header(part.path)
        cls_at, src_at, rgb_at = _LAS_LAYOUT[head["format"]]
        names = ["X", "Y", "Z", "intensity", "class", "source"] + (["red", "green", "blue"] if rgb_at is not None else [])
        offsets = [0, 4, 8, 12, cls_at, src_at] + ([rgb_at, rgb_at + 2, rgb_at + 4] if rgb_at is not None else [])
        kinds = ["<i4"] * 3 + ["<u2", "u1", "<u2"] + ["<u2"] * (len(names) - 6)
        dtype = np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": head["size"]})
        with open_read(part.path) as f:
            f.seek(head["start"] + part.start * head["size"])
            for lo, hi in part.steps():
                rows = np.frombuffer(f.read((hi - lo) * head["size"]), dtype=dtype)
                cols = {a: rows[a.upper()] * head["scale"][k] + head["offset"][k] for k, a in enumerate("xyz")}
                cols["class"] = rows["class"] & 31 if head["format"] < 6 else rows["class"]
                keep = np.ones(len(rows), bool)
                for axis, (low, high) in self.ranges.items():
                    keep &= (cols[axis] >= low) & (cols[axis] <= high)
                if self.classes is not None:
                    keep &= np.isin(cols["class"], self.classes)
                n = int(keep.sum())
                rgb = [pa.array(rows[c][keep].astype(np.int32)) if rgb_at is not None else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue")]
                yield pa.record_batch(
                    [pa.array([tile_name(part.path)] * n), pa.array(np.arange(lo, hi)[keep]), *[pa.array(cols[a][keep]) for a in "xyz"],
                     pa.array(rows["intensity"][keep].astype(np.int32)), pa.array(cols["class"][keep].astype(np.int16)),
                     pa.array(rows["source"][keep].astype(np.int32)), *rgb],
                    names=["tile_id", "point_idx", "x", "y", "z", "intensity", "class", "source_id", "red", "green", "blue"])


class LasWriter(PartWriter):
    """LAS 1.2, point format 2; needs options ``offset`` (x,y,z) common to all parts."""

    suffix = ".las"
    record = np.dtype({"names": ["X", "Y", "Z", "intensity", "flags", "class", "rank", "user", "source", "red", "green", "blue"],
                       "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1", "i1", "u1", "<u2", "<u2", "<u2", "<u2"]})

    def encode(self, batches, spool):
        offset = [float(v) for v in self.options.get("offset", "0,0,0").split(",")]
        body, total, lo, hi = spool(), 0, [np.inf] * 3, [-np.inf] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, self.record)
            for k, a in enumerate("xyz"):
                rows[a.upper()] = np.rint((to_numpy(batch, a) - offset[k]) / 0.001)
                lo[k], hi[k] = min(lo[k], float(rows[a.upper()].min())), max(hi[k], float(rows[a.upper()].max()))
            for name, field in (("intensity", "intensity"), ("class", "class"), ("source_id", "source"), ("red", "red"), ("green", "green"), ("blue", "blue")):
                if name in batch.schema.names:
                    rows[field] = to_numpy(batch, name)
            body.write(rows.tobytes())
            total += batch.num_rows
        if not total:
            return b"", [], {"count": 0}
        low = [offset[k] + lo[k] * 0.001 for k in range(3)]
        high = [offset[k] + hi[k] * 0.001 for k in range(3)]
        ends = [v for pair in zip(high, low) for v in pair]
        header = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"canopyframe", 1, 2000, 227, 227, 0,
                             2, self.record.itemsize, total, total, 0, 0, 0, 0, 0.001, 0.001, 0.001, *offset, *ends)
        return header, [body], {"count": total, "bbox_min": low, "bbox_max": high}


class LasSource(DataSource):
    """Uncompressed LAS 1.2-1.4. A window, height range or class list in the options skips files and rows early."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return LAS_SCHEMA

    def reader(self, schema):
        return LasReader(self.options)

    def writer(self, schema, overwrite):
        return LasWriter(self.options | {"overwrite": overwrite})


# ---- block binaries --------------------------------------------------------------------

_LAYOUTS = {
    "blocks": (("xyz", 12), ("rgb", 3)), "segmented": (("xyz", 12), ("rgb", 3), ("seg", 2)), "pcb1": (("xyz", 12), ("rgb", 3)),
    "cylinders": (("start", 12), ("end", 12), ("radius", 4), ("order", 4)), "cylinders_u8": (("start", 12), ("end", 12), ("radius", 4), ("order", 1))}
CYLINDER_SCHEMA = ("tree_id string, cyl_idx bigint, start_x double, start_y double, start_z double, end_x double, end_y double, "
                   "end_z double, radius double, branch_order int, off_x double, off_y double, off_z double")


def _sidecar(path: str) -> dict:
    with open_read(path.rsplit(".", 1)[0] + ".json") as f:
        return json.loads(f.read())


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.layout = options.get("layout", "blocks")
        self.count = options.get("count")

    def _count(self, path, size):
        if self.layout == "pcb1":
            with open_read(path) as f:
                magic, n = struct.unpack("<4sI", f.read(8))
            if magic != b"PCB1":
                raise ValueError(f"not a PCB1 file: {path}")
            return n
        if self.count:
            return int(self.count)
        try:
            return int(_sidecar(path)["count"])
        except FileNotFoundError:
            # parts written by this package hold nothing but the blocks
            return size // sum(w for _, w in _LAYOUTS[self.layout])

    def partitions(self):
        width = sum(w for _, w in _LAYOUTS[self.layout])
        return [p for path, size in list_files(self.path, (".bin",)) for p in row_ranges(path, self._count(path, size), width)]

    def read(self, part):
        with open_read(part.path) as f:
            size = f.size()
            rows, base = self._count(part.path, size), 8 if self.layout == "pcb1" else 0
            starts = {}
            for name, width in _LAYOUTS[self.layout]:
                starts[name] = (base, width)
                base += rows * width
            def block(name, lo, hi, dtype, shape):
                at, width = starts[name]
                f.seek(at + lo * width)
                return np.frombuffer(f.read((hi - lo) * width), dtype=dtype).reshape(shape)
            off = _sidecar(part.path).get("off", [0.0] * 3) if self.layout.startswith("cylinders") else None
            for lo, hi in part.steps():
                n = hi - lo
                if off is not None:
                    s, e = block("start", lo, hi, "<f4", (n, 3)), block("end", lo, hi, "<f4", (n, 3))
                    order = block("order", lo, hi, "<f4" if self.layout == "cylinders" else "u1", (n,))
                    cols = [pa.array([tile_name(part.path)] * n), pa.array(np.arange(lo, hi))]
                    cols += [pa.array(m[:, k].astype(np.float64)) for m in (s, e) for k in range(3)]
                    cols += [pa.array(block("radius", lo, hi, "<f4", (n,)).astype(np.float64)), pa.array(order.astype(np.int32))]
                    cols += [pa.array(np.full(n, float(v))) for v in off]
                    yield pa.record_batch(cols, names=[c.split()[0] for c in CYLINDER_SCHEMA.split(", ")])
                    continue
                xyz, rgb = block("xyz", lo, hi, "<f4", (n, 3)), block("rgb", lo, hi, "u1", (n, 3))
                batch = _point_batch(tile_name(part.path), lo, xyz.T, rgb.T)
                if self.layout == "segmented":
                    batch = batch.append_column("seg_id", pa.array(block("seg", lo, hi, "<u2", (n,)).astype(np.int32)))
                yield batch


class BlockWriter(PartWriter):
    """Blocks of xyz, colour and optional segment ids; ``layout=pcb1`` swaps to the y-up frame.

    ``origin`` (x,y,z) is subtracted first.
    """

    def encode(self, batches, spool):
        layout = self.options.get("layout", "blocks")
        origin = [float(v) for v in self.options.get("origin", "0,0,0").split(",")]
        blocks = {"xyz": spool(), "rgb": spool(), "seg": spool()}
        total, boxes = 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, z = (to_numpy(batch, a).astype(np.float64) - origin[k] for k, a in enumerate("xyz"))
            xyz = np.stack([x, z, -y] if layout == "pcb1" else [x, y, z], 1).astype("<f4")
            blocks["xyz"].write(xyz.tobytes())
            blocks["rgb"].write(np.clip(np.stack([to_numpy(batch, c) for c in "rgb"], 1), 0, 255).astype(np.uint8).tobytes())
            if layout == "segmented":
                seg = to_numpy(batch, "seg_id")
                if len(seg) and (seg.min() < 0 or seg.max() > 65535):
                    raise ValueError("segment ids beyond 16 bit don't fit this layout")
                blocks["seg"].write(seg.astype("<u2").tobytes())
            total += batch.num_rows
            boxes.append(box({a: xyz[:, k] for k, a in enumerate("xyz")}))
        if not total:
            return b"", [], {"count": 0}
        header = struct.pack("<4sI", b"PCB1", total) if layout == "pcb1" else b""
        order = [blocks["xyz"], blocks["rgb"]] + ([blocks["seg"]] if layout == "segmented" else [])
        return header, order, {"count": total, "origin_xyz": origin, **merge_boxes(boxes)}


class BlockSource(DataSource):
    """Block binaries; option ``layout`` is blocks, segmented, pcb1, cylinders or cylinders_u8."""

    @classmethod
    def name(cls):
        return "cloudbin"

    def schema(self):
        layout = self.options.get("layout", "blocks")
        if layout.startswith("cylinders"):
            return CYLINDER_SCHEMA
        return POINT_SCHEMA + (", seg_id int" if layout == "segmented" else "")

    def reader(self, schema):
        return BlockReader(self.options)

    def writer(self, schema, overwrite):
        return BlockWriter(self.options | {"overwrite": overwrite})


# ---- PLY ----------------------------------------------------------------------------------


def ply_header(path: str) -> dict:
    with open_read(path) as f:
        raw = f.read(65_536)
    end = raw.find(b"end_header\n")
    if end < 0:
        raise ValueError(f"incomplete PLY header in {path}")
    lines = raw[:end].decode("ascii").split("\n")
    if "format binary_little_endian 1.0" not in lines:
        raise ValueError(f"only binary little-endian PLY is supported: {path}")
    rows = next(int(ln.split()[2]) for ln in lines if ln.startswith("element vertex"))
    names = [ln.split()[2] for ln in lines if ln.startswith("property")]
    if any(ln.split()[1] not in ("float", "float32") for ln in lines if ln.startswith("property")):
        raise ValueError(f"only float properties are supported: {path}")
    return {"rows": rows, "names": names, "start": end + len(b"end_header\n")}


class PlyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        parts = []
        for path, _ in list_files(self.path, (".ply",)):
            head = ply_header(path)
            parts += row_ranges(path, head["rows"], 4 * len(head["names"]))
        return parts

    def read(self, part):
        head = ply_header(part.path)
        width = len(head["names"])
        with open_read(part.path) as f:
            f.seek(head["start"] + part.start * 4 * width)
            for lo, hi in part.steps():
                rows = np.frombuffer(f.read((hi - lo) * 4 * width), "<f4").reshape(hi - lo, width)
                yield pa.record_batch([pa.array([tile_name(part.path)] * (hi - lo)), pa.array(np.arange(lo, hi)),
                                       *[pa.array(rows[:, k]) for k in range(width)]], names=["file_id", "vertex_idx", *head["names"]])


class PlyWriter(PartWriter):
    suffix = ".ply"

    def encode(self, batches, spool):
        body, total, names = spool(), 0, None
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("file_id", "vertex_idx")]
            if batch.num_rows:
                body.write(np.stack([to_numpy(batch, n) for n in names], 1).astype("<f4").tobytes())
                total += batch.num_rows
        if not total:
            return b"", [], {"count": 0}
        lines = ["ply", "format binary_little_endian 1.0", f"element vertex {total}", *[f"property float {n}" for n in names], "end_header", ""]
        return "\n".join(lines).encode(), [body], {"count": total}


class PlySource(DataSource):
    """Vertex tables whose columns come from the header of the first file."""

    @classmethod
    def name(cls):
        return "plyvertex"

    def schema(self):
        first = list_files(self.options["path"], (".ply",))[0][0]
        return "file_id string, vertex_idx bigint, " + ", ".join(f"`{n}` float" for n in ply_header(first)["names"])

    def reader(self, schema):
        return PlyReader(self.options)

    def writer(self, schema, overwrite):
        return PlyWriter(self.options | {"overwrite": overwrite})


def register_sources(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    from canopyframe.sources.e57 import E57ImageSource
    for source in (PcdSource, LabelSource, LasSource, BlockSource, PlySource, E57ImageSource):
        spark.dataSource.register(source)
