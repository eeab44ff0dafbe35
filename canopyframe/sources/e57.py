"""Image records of E57 files: only the XML section and the image sections are read, never the points."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from canopyframe.sources.files import RowRange, list_files, open_read, tile_name

# fixed values: page size of the format and its payload before the checksum
PAGE = 1024
PAYLOAD = 1020
# fixed values: image representations of the format
REPRESENTATIONS = ("pinholeRepresentation", "sphericalRepresentation", "cylindricalRepresentation", "visualReferenceRepresentation")
SCHEMA = ("setup_id string, image_idx int, guid string, representation string, width int, height int, focal_length double, "
          "pixel_width double, pixel_height double, cx double, cy double, qw double, qx double, qy double, qz double, "
          "tx double, ty double, tz double, blob_offset bigint, blob_length bigint, blob_kind string, content binary")
_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])


def read_payload(f, offset: int, length: int) -> bytes:
    """``length`` payload bytes from a physical offset, checksums left out."""
    first, skip = divmod(offset, PAGE)
    if skip >= PAYLOAD:
        first, skip = first + 1, 0
    pages = -(-(skip + length) // PAYLOAD)
    f.seek(first * PAGE)
    raw = f.read(pages * PAGE)
    joined = b"".join(raw[k:k + PAYLOAD] for k in range(0, len(raw), PAGE))
    return joined[skip:skip + length]


def read_blob(f, offset: int, length: int) -> bytes:
    """Image bytes; the section header is skipped when the offset points at one."""
    probe = read_payload(f, offset, min(length, 16))
    known = probe.startswith(b"\xff\xd8\xff") or probe.startswith(b"\x89PNG")
    return read_payload(f, offset if known else offset + 16, length)


def _strip_namespaces(node):
    for el in node.iter():
        el.tag = el.tag.rsplit("}", 1)[-1]
    return node


def image_records(f, setup: str, with_content: bool) -> list[dict]:
    head = f.read(48)
    if head[:8] != b"ASTM-E57":
        raise ValueError(f"not an E57 file: {setup}")
    xml_at, xml_len = struct.unpack_from("<QQ", head, 24)
    root = _strip_namespaces(ET.fromstring(read_payload(f, xml_at, xml_len)))
    rows = []
    for k, image in enumerate(root.findall("images2D/vectorChild"), 1):
        text = lambda node, path: None if node is None else node.findtext(path)
        num = lambda node, path: None if not (text(node, path) or "").strip() else float(text(node, path))
        rep = next((r for r in REPRESENTATIONS if image.find(r) is not None), None)
        view = image.find(rep) if rep else None
        rotation, translation = image.find("pose/rotation"), image.find("pose/translation")
        blob = kind = None
        for tag in ("jpegImage", "pngImage"):
            if view is not None and view.find(tag) is not None:
                blob, kind = view.find(tag), tag[:-5]
                break
        row = {"setup_id": setup, "image_idx": k, "guid": text(image, "guid"), "representation": rep,
               "width": int(num(view, "imageWidth")) if num(view, "imageWidth") is not None else None,
               "height": int(num(view, "imageHeight")) if num(view, "imageHeight") is not None else None,
               "focal_length": num(view, "focalLength"), "pixel_width": num(view, "pixelWidth"), "pixel_height": num(view, "pixelHeight"),
               "cx": num(view, "principalPointX"), "cy": num(view, "principalPointY"),
               **{f"q{a}": num(rotation, a) for a in "wxyz"}, **{f"t{a}": num(translation, a) for a in "xyz"},
               "blob_offset": int(blob.get("fileOffset")) if blob is not None else None,
               "blob_length": int(blob.get("length")) if blob is not None else None, "blob_kind": kind, "content": None}
        if with_content and blob is not None:
            row["content"] = read_blob(f, row["blob_offset"], row["blob_length"])
        rows.append(row)
    return rows


class E57ImageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_content = options.get("content", "false").lower() == "true"

    def partitions(self):
        return [RowRange(path, 0, 0) for path, _ in list_files(self.path, (".e57",))]

    def read(self, part):
        with open_read(part.path) as f:
            for row in image_records(f, tile_name(part.path), self.with_content):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


class E57ImageSource(DataSource):
    """One row per image of each file; option ``content=true`` adds the image bytes."""

    @classmethod
    def name(cls):
        return "e57images"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return E57ImageReader(self.options)
