import json

from pyspark.sql import functions as F

from canopyframe.operators.inventory import SINGLE_SCAN, stem_inventory
from canopyframe.operators.jobs import latest_status
from canopyframe.plans.carriers import carrier
from canopyframe.streaming import ingest, job_stream


def _announce(folder, name, *notes):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("tile_id", "part", "n_parts", "path", "at"), n))) for n in notes))


def test_parts_over_several_runs_give_one_inventory(spark, sf_dir, tmp_path):
    notes, out, ck = tmp_path / "notes", str(tmp_path / "out"), str(tmp_path / "ck")
    pts = carrier(spark, sf_dir, "points").where("tile_id = 't0'").select(*[c.split()[0] for c in ingest.POINT_SCHEMA.split(", ")])
    pts = pts.withColumn("part", F.pmod(F.xxhash64("point_idx"), F.lit(3)))
    files = []
    for k in range(3):
        files.append(str(tmp_path / f"part{k}"))
        pts.where(F.col("part") == k).drop("part").write.parquet(files[-1])
    second = str(tmp_path / "second")
    pts.withColumn("tile_id", F.lit("second")).drop("part").write.parquet(second)
    levels = {"lite": (0.5, 100), "full": (0.1, 900)}

    def run(**more):
        query = ingest.ingest_clouds(spark, str(notes), out, ck, levels=levels, files_per_batch=1, **more)
        assert query.awaitTermination(120)
        assert query.exception() is None

    _announce(notes, "a", ("t0", 1, None, files[1]), (None, 0, 1, "nowhere"))
    run()
    assert not (tmp_path / "out" / "inventory").exists()
    _announce(notes, "b", ("t0", 0, None, "a file that is sent again"), ("t0", 2, None, files[2]))
    _announce(notes, "c", ("second", 0, 1, second), ("third", 0, 2, "never complete"))
    run()
    assert {r.tile_id for r in spark.read.parquet(f"{out}/inventory").select("tile_id").distinct().collect()} == {"second"}
    _announce(notes, "d", ("t0", 0, None, files[0]))
    _announce(notes, "e", ("t0", None, 3, None))
    run()
    got = {(r.tile_id, r.level): r["count"] for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert got == {(t, lv): n for t in ("t0", "second") for lv, n in (("lite", 100), ("full", 900))}
    kept = spark.read.parquet(f"{out}/inventory")
    want = stem_inventory(pts.drop("part"), SINGLE_SCAN)
    columns = ["label", "dbh_cm", "n_points"]
    assert kept.where("tile_id = 't0'").select(*columns).exceptAll(want.select(*columns)).isEmpty() and kept.count() == 2 * want.count()


def test_unfinished_uploads_are_given_up(spark, tmp_path):
    notes, out, ck = tmp_path / "notes", str(tmp_path / "out"), str(tmp_path / "ck")
    for name, hour, tile in (("a", 1, "x"), ("b", 2, "y"), ("c", 4, "z")):
        _announce(notes, name, (tile, 0, 2, f"file of {tile}", f"2026-01-01T{hour:02d}:00:00"))
        assert ingest.ingest_clouds(spark, str(notes), out, ck, wait_seconds=2.5 * 3600).awaitTermination(120)
    rows = spark.read.parquet(f"{out}/incomplete").collect()
    assert [(r.tile_id, r.complete, r.n_parts, r.paths) for r in rows] == [("x", False, 2, ["file of x"])]


def test_streamed_status_equals_batch(spark, sf_dir, tmp_path):
    events = carrier(spark, sf_dir, "job_events").select(*[c.split()[0] for c in job_stream.EVENT_SCHEMA.split(", ")])
    landing, sink, ck = (str(tmp_path / n) for n in ("landing", "sink", "ck"))
    events.repartition(4, "event_id").write.parquet(landing)
    stream = job_stream.read_events(spark, landing, files_per_batch=1)
    job_stream.stream_status(stream, sink, ck).awaitTermination()
    got = job_stream.current_status(spark, sink).select("job_id", "created", "updated", "status", "params")
    want = latest_status(events).select("job_id", "created", "updated", "status", "params")
    assert sorted(got.collect()) == sorted(want.collect())
