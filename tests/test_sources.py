import pytest
from pyspark.sql import functions as F

from pointloom.operators import projects
from pointloom.sources import las, rooms, views
from pointloom.streaming import sessions


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    path = str(tmp_path / "sample.las")
    assert las.write_las(views.grid_points(spark), path) == 1000
    d = spark.read.format("las").option("rowsPerSplit", 300).load(path)
    assert d.count() == 1000
    r = d.agg(F.min("x"), F.max("x"), F.max("z"), F.min("classification"), F.max("return_number"), F.max("number_of_returns"), F.countDistinct("point_id")).first()
    assert list(r) == [0, 9, 9, 2, 1, 1, 1000]
    row = d.where("point_id = 123").first()
    assert (row["x"], row["y"], row["z"], row["qx"], row["r"], row["g"], row["b"]) == (3, 2, 1, 3000, 123 * 257, 369 % 256 * 257, 861 % 256 * 257)
    assert spark.read.format("las").option("columns", "z,intensity").load(path).columns == ["z", "intensity"]
    h = spark.read.format("las_header").load(path).first()
    assert (h["legacy_count"], h["min_x"], h["max_z"], h["bytes_per_point"]) == (1000, 0, 9, 27)


def test_empty_las(spark, tmp_path):
    las.register(spark)
    assert las.write_las(views.grid_points(spark).limit(0), str(tmp_path / "e.las")) == 0
    assert spark.read.format("las").load(str(tmp_path / "e.las")).count() == 0


@pytest.mark.parametrize("name", ["a.laz", "a.pcd", "a"])
def test_unsupported_files(tmp_path, name):
    (tmp_path / name).write_bytes(b"LASF")
    with pytest.raises(ValueError):
        las.read_header(str(tmp_path / name))


def test_sources_must_agree(spark):
    p = views.grid_points(spark)
    assert las.union_sources([p, p.select(*reversed(p.columns))]).count() == 2000
    with pytest.raises(ValueError):
        las.union_sources([p, p.drop("r")])


def test_rooms(spark, tmp_path):
    room = tmp_path / "Area_2" / "office_1"
    room.mkdir(parents=True)
    (room / "office_1.txt").write_text("1 2 3 10 20 300\nbad line\n4 5 6 7 8\n")
    (tmp_path / "Area_2" / "notes.txt").write_text("1 2 3 4 5 6\n")
    got = rooms.read_rooms(spark, str(tmp_path)).collect()
    assert [(r["area"], r["room"], r["bad"]) for r in got] == [(2, "office_1", False), (2, "office_1", True), (2, "office_1", True)]
    assert (got[0]["x"], got[0]["r"], got[0]["b"]) == (1, 2570, 65535)


def test_projects(tmp_path):
    m = projects.ProjectFolder(str(tmp_path))
    made = [m.create("My scan", "a.las") for _ in range(3)]
    assert [p["path"].rsplit("/", 1)[1] for p in made] == ["My_scan", "My_scan-2", "My_scan-3"]
    assert {p["path"] for p in m.list()} == {p["path"] for p in made}
    for p in (made[0], made[1], made[0]):
        m.touch(p["path"])
    assert [p["path"] for p in m.recent()] == [made[0]["path"], made[1]["path"]]
    for k in range(15):
        m.touch(m.create(f"n{k}")["path"])
    assert len(m.recent()) == 10
    assert m.delete(made[2]["path"]) and made[2]["path"] not in {p["path"] for p in m.list()}
    last = m.recent()[0]["path"]
    (tmp_path / "projects" / last.rsplit("/", 1)[1] / "project.json").unlink()
    assert last not in {p["path"] for p in m.recent()}
    with pytest.raises(RuntimeError):
        m.imported("broken", "x.las", lambda path: (_ for _ in ()).throw(RuntimeError()))
    assert not [p for p in m.list() if p["name"] == "broken"]


def test_residency(spark):
    f = spark.createDataFrame([(1, 0, n) for n in "abcd"] + [(1, 1, "a"), (1, 2, "b")], "session long, frame long, node string")
    got = [tuple(r) for r in sessions.lru_trace(f, 2).orderBy("frame").collect()]
    assert got == [(1, 0, 4, 0), (1, 1, 2, 2), (1, 2, 2, 1)] or got == [(1, 0, 4, 0), (1, 1, 2, 2), (1, 2, 2, 1)]


def test_measurement_stream(spark, tmp_path):
    rows = [(k % 2, k, float(k), 0.0, 0.0) for k in range(12)]
    for part in range(3):
        spark.createDataFrame(rows[part * 4 : part * 4 + 4], "session long, event_id long, x double, y double, z double").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("session long, event_id long, x double, y double, z double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions.measurement_stream(stream).writeStream.format("memory").queryName("measured").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("measured").collect())
    assert [(s, m) for s, m, _ in got] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)] and all(v == 2.0 for *_, v in got)
