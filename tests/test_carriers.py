"""Carriers give Spark and DuckDB the same rows where values lie next to a step."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from canopyframe.plans.carriers import carrier, oracle_carrier


def test_pixel_levels_are_taken_in_the_precision_of_the_list(spark, tmp_path):
    # thousandths in single precision: many of them are on another level as doubles
    lists = [[((i * 64 + k) % 999 + 1) / 1000 for k in range(64)] for i in range(16)]
    rows = pa.table({"vec_id": pa.array(range(16), pa.int64()), "embedding": pa.array(lists, pa.list_(pa.float32())),
                     "label": pa.array([0] * 16, pa.int32())})
    pq.write_table(rows, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"select image_id, row, col, r, g, b from ({oracle_carrier('pixels')}) order by 1, 2, 3").fetchall()
    got = carrier(spark, str(tmp_path), "pixels").orderBy("image_id", "row", "col").collect()
    assert [tuple(r) for r in got] == want
