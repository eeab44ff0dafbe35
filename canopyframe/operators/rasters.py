"""Images as tiles: block arrays that carry the pixels next to them, and resampling by gathers per tile.

A tile row is ``image_id, trow, tcol, data``. ``data`` holds SIZE x SIZE pixels (fewer at
the right and lower edge) plus one row and one column of the neighbours, three
16-bit numbers a pixel, -1 where the image has none. A sample and the pixels around it
lie in one tile, so resampling is one join of output blocks with the tiles that they
touch; no row is made for a single ray or pixel before the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of a tile and of an output block.
SIZE, BLOCK = 256, 64

#: Maps parameters and pixel places of an output block to samples: ``out_row, out_col, row, col`` and what the reducer needs.
Locate = Callable[[dict, np.ndarray, np.ndarray], dict[str, np.ndarray]]
#: Turns samples and the pixels at and around them (``at(dr, dc)``, -1 where missing) into columns; ``keep`` marks the rows that count.
Reduce = Callable[[dict[str, np.ndarray], Callable[[int, int], np.ndarray]], dict[str, np.ndarray]]


def tiles_of(image: np.ndarray, wrap: bool, size: int = SIZE) -> Iterator[tuple[int, int, bytes]]:
    """Tiles of one image (rows x columns x 3); ``wrap``: the first column is the right neighbour of the last."""
    h, w = image.shape[:2]
    framed = np.full((h + 1, w + 1, 3), -1, np.int16)
    framed[:h, :w] = image
    if wrap:
        framed[:h, w] = image[:, 0]
    for top in range(0, h, size):
        for left in range(0, w, size):
            yield top // size, left // size, framed[top:min(top + size, h) + 1, left:min(left + size, w) + 1].tobytes()


def read_image_tiles(spark: SparkSession, path: str, wrap: bool = True, size: int = SIZE) -> DataFrame:
    """Tiles of image files, straight from the decoder; ``image_id`` is the file name."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img in batch.column("image").to_pylist():
                data = np.frombuffer(img["data"], np.uint8).reshape(img["height"], img["width"], img["nChannels"])
                rgb = np.stack([data[..., min(k, img["nChannels"] - 1)] for k in (2, 1, 0)], axis=-1)
                name = img["origin"].rsplit("/", 1)[-1]
                for trow, tcol, body in tiles_of(rgb, wrap, size):
                    yield pa.record_batch([pa.array([name]), pa.array([trow], pa.int32()), pa.array([tcol], pa.int32()), pa.array([body], pa.binary())],
                                          names=["image_id", "trow", "tcol", "data"])

    return spark.read.format("image").load(path).mapInArrow(expand, "image_id string, trow int, tcol int, data binary")


def pixel_tiles(pixels: DataFrame, width: int, height: int, wrap: bool = True, size: int = SIZE) -> DataFrame:
    """Tiles of a pixel table ``image_id, row, col, r, g, b``.

    Pixels outside the image are left out; of pixels that are there twice any one counts. Values must fit 15 bits.
    """
    last = (width - 1) // size

    def places(c: str, n: int, around: bool) -> F.Column:
        """Tile and place in it; the first pixel of a tile is also the neighbour that closes the tile before."""
        own = F.struct((F.col(c) / size).cast("int").alias("t"), F.pmod(F.col(c), F.lit(size)).cast("int").alias("at"))
        before = F.struct(((F.col(c) / size).cast("int") - 1).alias("t"), F.lit(size).alias("at"))
        edge = F.struct(F.lit(last).alias("t"), F.lit(width - last * size).alias("at"))
        also = F.when((F.col(c) > 0) & (F.pmod(F.col(c), F.lit(size)) == 0), F.array(before))
        if around:
            also = F.when(F.col(c) == 0, F.array(edge)).otherwise(also)
        return F.concat(F.array(own), F.coalesce(also, F.array().cast("array<struct<t:int,at:int>>")))

    inside = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    placed = inside.withColumn("_r", F.explode(places("row", height, False))).withColumn("_c", F.explode(places("col", width, wrap)))
    placed = placed.select("image_id", F.col("_r.t").alias("trow"), F.col("_c.t").alias("tcol"), F.col("_r.at").alias("y"), F.col("_c.at").alias("x"),
                           *[F.col(c).cast("smallint") for c in "rgb"])

    def pack(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in ("trow", "tcol", "y", "x", "r", "g", "b")}
        trow, tcol = int(t["trow"][0]), int(t["tcol"][0])
        data = np.full((min(size, height - trow * size) + 1, min(size, width - tcol * size) + 1, 3), -1, np.int16)
        data[t["y"], t["x"]] = np.stack([t[c] for c in "rgb"], axis=-1)
        return pa.table({"image_id": table.column("image_id")[:1], "trow": pa.array([trow], pa.int32()), "tcol": pa.array([tcol], pa.int32()),
                         "data": pa.array([data.tobytes()], pa.binary())})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return placed.groupBy("image_id", "trow", "tcol").applyInArrow(pack, f"image_id {kind}, trow int, tcol int, data binary")


def _block_places(o: dict, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    y = np.arange(o["brow"] * BLOCK, min((o["brow"] + 1) * BLOCK, rows))
    x = np.arange(o["bcol"] * BLOCK, min((o["bcol"] + 1) * BLOCK, cols))
    return np.repeat(y, len(x)), np.tile(x, len(y))


def resample(requests: DataFrame, tiles: DataFrame, keys: list[str], out_rows: int, out_cols: int, src_rows: int, src_cols: int,
             locate: Locate, reduce: Reduce, values: str, skip: Callable[[dict, np.ndarray, np.ndarray], np.ndarray] | None = None,
             size: int = SIZE) -> DataFrame:
    """``keys, out_row, out_col`` and ``values`` of the samples of each request's output image.

    ``requests`` has ``keys``, ``image_id`` and number columns that ``locate`` reads. ``skip`` may name
    output blocks (by the places of their centres) that hold no sample. Samples outside the source and
    in tiles that don't exist give no row.
    """
    params = [c for c in requests.columns if c not in ("image_id", *keys)]
    across = -(-out_cols // BLOCK)
    blocks = requests.withColumn("brow", F.explode(F.sequence(F.lit(0), F.lit(-(-out_rows // BLOCK) - 1))))

    def samples(o: dict) -> dict[str, np.ndarray]:
        found = locate(o, *_block_places(o, out_rows, out_cols))
        ok = (found["row"] >= 0) & (found["row"] < src_rows) & (found["col"] >= 0) & (found["col"] < src_cols)
        return {k: v[ok] for k, v in found.items()}

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, o in enumerate(batch.to_pylist()):
                columns = np.arange(across)
                if skip is not None:
                    mid = (columns + 0.5) * BLOCK
                    columns = columns[~skip(o, np.full(len(mid), (o["brow"] + 0.5) * BLOCK), mid)]
                where = []
                for b in columns:
                    s = samples({**o, "bcol": int(b)})
                    tile = np.unique((s["row"] // size).astype(np.int64) * (src_cols + 1) + (s["col"] // size).astype(np.int64))
                    where.append(np.column_stack([np.full(len(tile), b), tile // (src_cols + 1), tile % (src_cols + 1)]))
                pairs = np.concatenate(where) if where else np.zeros((0, 3), np.int64)
                if len(pairs):
                    again = batch.take(pa.array(np.full(len(pairs), i)))
                    yield pa.RecordBatch.from_arrays([*again.columns, *(pa.array(pairs[:, k].astype(np.int32)) for k in range(3))],
                                                     names=[*batch.schema.names, "bcol", "trow", "tcol"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields)
    pairs = blocks.mapInArrow(touched, f"{kinds}, bcol int, trow int, tcol int")
    names = [v.split()[0] for v in values.split(",")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index("data"))
            for i, o in enumerate(batch.select([*keys, *params, "brow", "bcol", "trow", "tcol"]).to_pylist()):
                s = samples(o)
                mine = (s["row"] // size == o["trow"]) & (s["col"] // size == o["tcol"])
                s = {k: v[mine] for k, v in s.items()}
                data = np.frombuffer(bodies[i].as_buffer(), np.int16).reshape(-1, min(size, src_cols - o["tcol"] * size) + 1, 3)
                y, x = (s["row"] - o["trow"] * size).astype(np.int64), (s["col"] - o["tcol"] * size).astype(np.int64)
                out = reduce(s, lambda dr, dc: data[y + dr, x + dc])  # noqa: B023
                keep = out.pop("keep")
                n = int(keep.sum())
                if n:
                    own = [batch.column(k).take(pa.array(np.full(n, i))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(s["out_row"][keep].astype(np.int32)), pa.array(s["out_col"][keep].astype(np.int32)),
                                                      *(pa.array(out[v][keep]) for v in names)], names=[*keys, "out_row", "out_col", *names])

    joined = pairs.join(tiles, ["image_id", "trow", "tcol"]).select(*keys, *params, "brow", "bcol", "trow", "tcol", "data")
    own = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys)
    return joined.mapInArrow(gather, f"{own}, out_row int, out_col int, {values}")


def nearest(s: dict[str, np.ndarray], at: Callable[[int, int], np.ndarray]) -> dict[str, np.ndarray]:
    """The pixel itself."""
    p = at(0, 0).astype(np.int32)
    return {"r": p[:, 0], "g": p[:, 1], "b": p[:, 2], "keep": (p >= 0).all(axis=1)}


def bilinear(s: dict[str, np.ndarray], at: Callable[[int, int], np.ndarray]) -> dict[str, np.ndarray]:
    """Weighted by the shares ``fx, fy`` of the right and the lower neighbour; missing ones add nothing."""
    total, found = np.zeros((len(s["row"]), 3)), np.zeros(len(s["row"]), bool)
    for dr in (0, 1):
        for dc in (0, 1):
            p = at(dr, dc)
            there = (p >= 0).all(axis=1)
            weight = (s["fy"] if dr else 1 - s["fy"]) * (s["fx"] if dc else 1 - s["fx"])
            total += np.where(there[:, None], p, 0) * weight[:, None]
            found |= there
    total = np.clip(total, 0.0, 255.0)
    return {"r": total[:, 0], "g": total[:, 1], "b": total[:, 2], "keep": found}
