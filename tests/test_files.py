"""Sources, sinks and entry points."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold import __main__ as cli
from lumenfold import api, kernels
from lumenfold.sources import captures, colmap, ply, sinks


def points_file(path, n=10, seed=0):
    rng = np.random.default_rng(seed)
    v = np.zeros(n, dtype=[(c, ply.TYPES[t]) for c, t in ply.POINT_LAYOUT])
    for c in v.dtype.names:
        v[c] = rng.random(n) if c in "xyz" else rng.integers(0, 256, n)
    path.write_bytes(ply.header_of(list(ply.POINT_LAYOUT), n) + v.tobytes())
    return v


def test_points_round_trip(spark, tmp_path):
    ply.register(spark)
    v = points_file(tmp_path / "a.ply", 25)
    df = spark.read.format("plypoints").option("path", f"{tmp_path}/a.ply").option("rowsPerSplit", 7).load()
    assert df.rdd.getNumPartitions() == 4
    got = df.orderBy("pid").toPandas()
    for c in v.dtype.names:
        assert np.allclose(got[c], v[c].astype(float))
    df.repartition(3).sortWithinPartitions("pid").coalesce(1).orderBy("pid").write.format("plypoints").option("path", f"{tmp_path}/b.ply").mode("overwrite").save()
    assert (tmp_path / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes()


def test_point_files_by_uri_and_after_failures(spark, tmp_path):
    """Paths may be URIs; what exists stays without overwriting; a write that fails leaves nothing."""
    ply.register(spark)
    v, at = points_file(tmp_path / "a.ply", 25), f"file://{tmp_path}"
    df = spark.read.format("plypoints").option("path", f"{at}/a.ply").option("rowsPerSplit", 7).load()
    df.write.format("plypoints").option("path", f"{at}/b.ply").mode("append").save()
    assert (tmp_path / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes() and len(v) == 25
    with pytest.raises(Exception, match="b.ply"):
        df.where("pid < 3").write.format("plypoints").option("path", f"{at}/b.ply").mode("append").save()
    bad = df.withColumn("x", F.expr("if(pid = 20, raise_error('bad row'), x)"))
    with pytest.raises(Exception, match="bad row"):
        bad.write.format("plypoints").option("path", f"{at}/b.ply").mode("overwrite").save()
    assert (tmp_path / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes()
    df.limit(0).write.format("plypoints").option("path", f"{at}/none.ply").mode("append").save()
    assert ply.Header((tmp_path / "none.ply").read_bytes()).vertices == 0
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["a.ply", "b.ply", "none.ply"]


def test_splat_layout(spark, tmp_path):
    ply.register(spark)
    cols = [*ply.SPLAT_FIXED, "f_rest_0", "f_rest_1", *ply.SPLAT_LAST]
    df = spark.createDataFrame(pd.DataFrame({"pid": [0, 1], **{c: [0.5, -1.0] for c in cols}})).coalesce(1)
    df.write.format("plypoints").option("path", f"{tmp_path}/s.ply").option("layout", "splat").mode("overwrite").save()
    raw, _ = ply.parse((tmp_path / "s.ply").read_bytes())
    assert list(raw) == cols and all(list(raw[c]) == [0.5, -1.0] for c in cols)


def box_file(path, shift=(0, 0, 0), colours=True):
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float) + shift
    t = np.array([(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)])
    path.write_bytes(ply.mesh_bytes(v, t, np.full((8, 3), 0.6) if colours else None))
    return v, t


def test_mesh_file(spark, tmp_path):
    v, t = box_file(tmp_path / "m.ply")
    vertices, triangles = ply.read_ply(spark, f"{tmp_path}/m.ply")
    got = vertices.orderBy("vid").toPandas()
    assert np.allclose(got[["x", "y", "z"]], v) and np.allclose(got["r"], 153 / 255)
    assert (triangles.orderBy("tid").toPandas()[["a", "b", "c"]].to_numpy() == t).all()
    box_file(tmp_path / "n.ply", colours=False)
    grey = ply.read_ply(spark, f"{tmp_path}/n.ply")[0].first()
    assert (grey.r, grey.g, grey.b) == (0.62, 0.60, 0.57)
    text = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    raw, faces = ply.parse(text.encode())
    assert len(raw["x"]) == 4 and faces.tolist() == [[0, 1, 2], [0, 2, 3]]
    cut = (tmp_path / "n.ply").read_bytes()[:-200]
    assert len(ply.parse(cut)[0]["x"]) <= 8
    with pytest.raises(ValueError):
        ply.parse(b"nope")


def test_sparse_model(spark, tmp_path):
    cams = spark.createDataFrame([(1, 640, 480, 500.0, 501.0, 320.0, 240.0)], "camera_id long, width long, height long, fx double, fy double, cx double, cy double")
    imgs = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 2.0], 1, "a.png"), (2, [0.5, 0.5, 0.5, 0.5], [3.0, 4.0, 5.0], 1, "b.png")], "image_id long, q array<double>, t array<double>, camera_id long, name string")
    pts = spark.createDataFrame([(k, k * 1.0, -k * 1.0, 0.5, k, 2, 3) for k in range(9)], "pid long, x double, y double, z double, r int, g int, b int")
    colmap.write_model(str(tmp_path), cams, imgs, pts.repartition(3))
    blob = (tmp_path / "points3D.bin").read_bytes()
    assert struct.unpack_from("<Q", blob)[0] == 9 and len(blob) == 8 + 9 * (43 + 8 + 24)
    c, i, p = colmap.read_model(spark, str(tmp_path))
    assert c.first().fx == 500.0 and [r.name for r in i.orderBy("image_id").collect()] == ["a.png", "b.png"]
    rows = p.orderBy("pid").collect()
    assert [r.pid for r in rows] == list(range(9)) and rows[4].x == 4.0 and rows[4].r == 4 and rows[4].track == 3


def test_sparse_points_in_ranges(spark, tmp_path):
    """Tracks of any length, none and long ones among them, are kept, and points are read in many stretches."""
    rng = np.random.default_rng(3)
    views = [[(int(i), int(p)) for i, p in rng.integers(0, 99, (n, 2))] for n in [0, 0, 3, 3, 3, 700, 1, 2, *rng.integers(0, 9, 300).tolist()]]
    rows = [(k, k * 0.5, 0.0, -1.0, k % 256, 0, 9, v) for k, v in enumerate(views)]
    pts = spark.createDataFrame(rows, f"pid long, x double, y double, z double, r int, g int, b int, views {colmap.VIEWS}")
    none = pts.select("pid", "pid").limit(0)
    cams = none.selectExpr("1 as camera_id", "1L as width", "1L as height", "1d as fx", "1d as fy", "1d as cx", "1d as cy")
    imgs = none.selectExpr("1L as image_id", "array(1d) as q", "array(1d) as t", "1L as camera_id", "'' as name")
    colmap.write_model(str(tmp_path), cams, imgs, pts.repartition(3))
    for size in (1, 1000, 1 << 25):
        got = colmap.read_model(spark, str(tmp_path), size)[2]
        assert got.rdd.getNumPartitions() > (100 if size == 1 else 10) if size < 9999 else got.rdd.getNumPartitions() == 1
        assert [(r.pid, r.x, r.r, r.track, [tuple(v) for v in r.views]) for r in got.orderBy("pid").collect()] == [(k, k * 0.5, k % 256, len(v), v) for k, v in enumerate(views)]
    blob = (tmp_path / "points3D.bin").read_bytes()
    (tmp_path / "points3D.bin").write_bytes(blob[:-30])
    with pytest.raises(Exception, match="missing"):
        colmap.read_model(spark, str(tmp_path), 1000)
    colmap.write_model(str(tmp_path), cams, imgs, pts.limit(0))
    assert colmap.read_model(spark, str(tmp_path))[2].count() == 0


def test_capture_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"summary": {"video": "v"}, "frames": [{"index": i, "time_s": i / 30, "sharpness": 1.0, "motion": 0.0, "selected": i % 2 == 1, "reason": "", "path": None, "thumb": None} for i in range(6)]}))
    (tmp_path / "p.json").write_text(json.dumps({"intrinsics": [1.0, 2.0, 3.0, 4.0], "frames": [{"cameraPose": [float(k + i) for k in range(16)]} for i in range(6)]}))
    src = captures.keyframe_sources(spark, f"{tmp_path}/r.json").orderBy("ordinal").collect()
    assert [(r.ordinal, r["index"]) for r in src] == [(0, 1), (1, 3), (2, 5)]
    images = spark.createDataFrame([("x/frame_0000.jpg",), ("x/frame_0002.jpg",), ("x/other.jpg",)], "path string")
    v = captures.views(spark, images, f"{tmp_path}/r.json", f"{tmp_path}/p.json").orderBy("ordinal").collect()
    assert [(r.ordinal, r["index"]) for r in v] == [(0, 1), (2, 5)] and v[0].fx == 1.0 and v[0].c2w[0][0] == 1.0 and v[0].c2w[0][1] == -5.0
    (tmp_path / "c.json").write_text(json.dumps({"views": [{"image": "a", "K": [[1.0]], "c2w": [[2.0]]}]}))
    assert captures.cameras(spark, f"{tmp_path}/c.json").first().image == "a"
    frames = [{"file_path": n, "depth_file_path": "d", "transform_matrix": [[1.0, 2, 3, 4]] * 4} for n in ("b", "a")]
    (tmp_path / "t.json").write_text(json.dumps({"w": 4, "h": 3, "fl_x": 1.0, "fl_y": 1.0, "cx": 2.0, "cy": 1.5, "frames": frames}))
    t = captures.transforms(spark, f"{tmp_path}/t.json").orderBy("ordinal").collect()
    assert [r.file_path for r in t] == ["a", "b"] and t[0].c2w[0] == [1, -2, -3, 4] and t[0].c2w[3] == [1, 2, 3, 4]
    (tmp_path / "traj.txt").write_text(" ".join(map(str, range(16))) + "\n1 2 3\n" + "  ".join(map(str, range(16, 32))) + "\n")
    tr = captures.trajectory_text(spark, f"{tmp_path}/traj.txt").orderBy("step").collect()
    assert [r.step for r in tr] == [0, 2] and tr[1].m[1][0] == 20.0
    (tmp_path / "d.json").write_text(json.dumps({"transform": [[1.0, 0, 0, 0]]}))
    assert captures.dataparser(spark, f"{tmp_path}/d.json").first().scale == 1.0
    (tmp_path / "path.json").write_text(json.dumps({"poses": [[[1.0]], [[2.0]]], "hfov": 90.0, "width": 4, "height": 2}))
    assert [r.step for r in captures.agent_path(spark, f"{tmp_path}/path.json").collect()] == [0, 1]
    np.savez(tmp_path / "s.npz", scale_mat_1=np.eye(4) * 3, scale_mat_0=np.eye(4) * 2, other=1)
    m = captures.scale_matrix(spark, f"{tmp_path}/s.npz").first()
    assert m.name == "scale_mat_0" and m.m[1][1] == 2.0
    (tmp_path / "img").mkdir()
    for k in range(9):
        (tmp_path / "img" / f"{k}.{'PNG' if k % 2 else 'jpg'}").write_bytes(b"x")
    (tmp_path / "img" / "note.txt").write_bytes(b"x")
    assert captures.image_folder(spark, f"{tmp_path}/img").count() == 9 and captures.image_folder(spark, f"{tmp_path}/img", 4).count() == 4


def metric_tree(folder):
    for s, m, c, n in (("hall", "one", 0.015, 0.97), ("attic", "one", 0.025, 0.95), ("hall", "two", 0.006, 0.99)):
        d = folder / f"{s}_{m}"
        d.mkdir(parents=True)
        (d / f"{s}_{m}_metrics.json").write_text(json.dumps({"Acc": 0.01, "Comp": 0.02, "C-L1": c, "NC": n, "F-score": n}))
    (folder / "bad_x_metrics.json").write_text("{oops")


def test_collate(spark, tmp_path, capsys):
    metric_tree(tmp_path / "eval")
    out = api.collate(spark, f"{tmp_path}/eval")
    assert np.isclose(out["AVG"]["one"]["C-L1"], 0.020) and np.isclose(out["AVG"]["two"]["C-L1"], 0.006)
    assert set(out["hall"]["one"]) == {"Acc", "Comp", "C-L1", "NC", "F-score"} and "bad" not in out
    assert "| hall | one | 1.00 | 2.00 | 1.50 | 0.970 | 0.970 |" in capsys.readouterr().out
    assert api.collate(spark, f"{tmp_path}/nowhere") == {}


def test_fuse(spark, tmp_path):
    box_file(tmp_path / "a.ply")
    box_file(tmp_path / "b.ply", (0.5, 0, 0))
    d = api.fuse_consensus(spark, f"{tmp_path}/a.ply", f"{tmp_path}/b.ply", f"{tmp_path}/o.ply")
    assert d["out_tris"] > 0 and d["donor_gapfill_frac"] == 1.0 and d["surface"] == "implicit grid"
    made, faces = ply.parse((tmp_path / "o.ply").read_bytes())
    assert len(faces) == d["out_tris"] and {"red", "green", "blue"} <= set(made) and faces.max() == len(made["x"]) - 1
    cfg = api.ConsensusConfig()
    assert cfg.tau > 0 and cfg.poisson_depth >= 8 and cfg.target_tris > 0
    moved = api.ConsensusConfig(donor_transform=((1.0, 0.0, 0.0, -0.5), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)))
    assert api.fuse_consensus(spark, f"{tmp_path}/a.ply", f"{tmp_path}/b.ply", f"{tmp_path}/o.ply", moved)["donor_gapfill_pts"] == 0


def test_fuse_with_a_kernel(spark, tmp_path):
    box_file(tmp_path / "a.ply")
    box_file(tmp_path / "b.ply", (3, 0, 0))

    def surface(points, depth):
        v, t = ply.read_ply(spark, f"{tmp_path}/a.ply")
        return v.withColumn("density", F.lit(1.0)), t

    kernels.register("poisson", surface)
    try:
        d = api.fuse_consensus(spark, f"{tmp_path}/a.ply", f"{tmp_path}/b.ply", f"{tmp_path}/o.ply")
    finally:
        kernels._KERNELS.clear()
    assert d["out_tris"] == 12
    with pytest.raises(kernels.MissingKernel):
        kernels.get("poisson")
    with pytest.raises(ValueError):
        kernels.register("other", surface)


def test_decimate_and_export(spark, tmp_path, capsys):
    box_file(tmp_path / "a.ply")
    d = api.decimate(spark, f"{tmp_path}/a.ply", f"{tmp_path}/small.ply", 300)
    assert d["in_tris"] == d["out_tris"] == 12
    for target in (5, 1):
        assert api.decimate(spark, f"{tmp_path}/a.ply", f"{tmp_path}/small.ply", target)["out_tris"] <= target
    colours = {"red": 0, "green": 0, "blue": 0}
    flat = ply.mesh_bytes(np.eye(3), np.array([[0, 1, 2]]), np.full((3, 3), 0.5))
    (tmp_path / "c.ply").write_bytes(flat)
    api.decimate(spark, f"{tmp_path}/c.ply", f"{tmp_path}/c2.ply")
    kept = ply.parse((tmp_path / "c2.ply").read_bytes())[0]
    assert all((kept[c] == 127).all() for c in colours)
    assert all((a == b).all() for a, b in zip(sinks.glb_arrays(sinks.glb_bytes(np.eye(3), np.array([[0, 1, 2]]))), (np.eye(3), [[0, 1, 2]])))
    out = cli.main(["embodied", "--mesh", f"{tmp_path}/a.ply", "--out", f"{tmp_path}/sim"])
    assert out["source_to_sim_R"] == [[1.0, 0.0, 0.0], [0.0, 0.0, -1.0], [0.0, 1.0, 0.0]]
    blob = (tmp_path / "sim" / "a.glb").read_bytes()
    assert blob[:4] == b"glTF" and struct.unpack_from("<I", blob, 8)[0] == len(blob)
    assert json.loads((tmp_path / "sim" / "manifest.json").read_text())["mesh_glb"] == "a.glb"
    with pytest.raises(ValueError):
        api.export_for_sim(spark, f"{tmp_path}/a.ply", f"{tmp_path}/sim", up="x")
    cli.main(["reconstruct"])
    assert "kernel" in capsys.readouterr().out


def test_ingest(spark, tmp_path):
    from lumenfold.operators.frames import IngestConfig

    clip = captures.synthetic_clip(spark)
    out = api.run_ingest(spark, clip, f"{tmp_path}/r", IngestConfig(target_frames=20, proc_width=48))
    assert out["analysed_frames"] == 150 and 0 < out["selected_frames"] <= 20 and out["dropped_blur"] + out["dropped_redundant"] + out["selected_frames"] <= 150
    rep = json.loads((tmp_path / "r" / "frame_report.json").read_text())
    assert set(rep["summary"]) == {"analysed_frames", "selected_frames", "dropped_blur", "dropped_redundant", "median_sharpness", "blur_threshold", "total_motion", "video", "fps", "config"}
    blurred = np.mean([f["sharpness"] for f in rep["frames"] if f["index"] in captures.CLIP_BLURRED])
    assert blurred < 0.8 * np.median([f["sharpness"] for f in rep["frames"]])
    assert captures.keyframe_sources(spark, f"{tmp_path}/r/frame_report.json").count() == out["selected_frames"]
    assert "<table>" in (tmp_path / "r" / "report.html").read_text()
    with pytest.raises(ValueError):
        api.run_ingest(spark, clip.limit(0), f"{tmp_path}/e")


def test_other_sinks(spark, tmp_path):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long")
    lines = [r.value for r in sinks.obj_lines(v, t).collect()]
    assert lines == ["v 0.0 0.0 0.0", "v 1.0 0.0 0.0", "v 0.0 1.0 0.0", "f 1 2 3"]
    cams = spark.createDataFrame([(1, "b", [[1.0]], [[2.0]]), (0, "a", [[1.0]], [[2.0]])], "view_id int, image string, K array<array<double>>, c2w array<array<double>>")
    sinks.cameras_json(cams, f"{tmp_path}/c.json")
    assert [x["image"] for x in json.loads((tmp_path / "c.json").read_text())["views"]] == ["a", "b"]
    sinks.write_csv(v, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    with pytest.raises(ValueError):
        sinks.mesh_arrays(v, t, 0)
    with pytest.raises(ValueError):
        sinks.mesh_arrays(v.where("vid < 2"), t)
    with pytest.raises(ValueError):
        sinks.mesh_arrays(v, t, 2)


def test_points_to_a_mesh(spark, tmp_path):
    """A hollow ball of points becomes a mesh near it, through the command line."""
    rng = np.random.default_rng(2)
    n = rng.normal(size=(2500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    kind = [(c, "<f4") for c in "xyz"]
    a = np.zeros(len(n), dtype=kind)
    for i, c in enumerate("xyz"):
        a[c] = n[:, i]
    (tmp_path / "p.ply").write_bytes(ply.header_of([(c, "float") for c in "xyz"], len(n), 0) + a.tobytes())
    out = cli.main(["mesh", "--ply", f"{tmp_path}/p.ply", "--out", f"{tmp_path}/m.glb", "--voxel", "0.12", "--target-tris", "900"])
    v, t = sinks.glb_arrays((tmp_path / "m.glb").read_bytes())
    assert 100 < out["out_tris"] == len(t) <= 900 and out["thinned"] < 2500 and abs(np.linalg.norm(v, axis=1) - 1).max() < 0.15
    assert spark.read.text(f"{tmp_path}/m.obj").where("value like 'f %'").count() == len(t)


def test_files_written_by_tasks_and_read_by_pattern(spark, tmp_path):
    """Names hold, whole contents too, again and in deep folders; readers keep captures apart."""
    from lumenfold.sources import files

    rows = [(f"c{k}/deep/frame_{n:04d}.jpg", bytes([k, n, 255])) for k in range(3) for n in range(k + 1)]
    rows += [(f"c{k}/report.json", f'{{"frames": [{{"index": {10 * k + 4}, "selected": true}}, {{"index": {10 * k}, "selected": true}}, {{"index": 1, "selected": false}}]}}'.encode()) for k in range(3)]
    df = spark.createDataFrame(rows, "name string, content binary")
    for _ in range(2):
        assert files.write_many(df.repartition(4), f"file://{tmp_path}/many") == len(rows)
    found = sorted(str(p.relative_to(tmp_path / "many")) for p in (tmp_path / "many").rglob("*") if p.is_file())
    assert found == sorted(n for n, _ in rows) and (tmp_path / "many" / "c2" / "deep" / "frame_0001.jpg").read_bytes() == bytes([2, 1, 255])
    assert files.write_many(df.limit(0), f"{tmp_path}/none") == 0
    images = captures.image_files(spark, f"{tmp_path}/many/*/deep", True)
    assert {(r.capture, r["count"]) for r in images.groupBy("capture").count().collect()} == {("c0", 1), ("c1", 2), ("c2", 3)}
    order = captures.keyframe_sources(spark, f"{tmp_path}/many/*/report.json", True).collect()
    assert {(r.capture, r.ordinal, r["index"]) for r in order} == {(f"c{k}", n, 10 * k + 4 * n) for k in range(3) for n in range(2)}


def test_camera_documents_by_capture(spark, tmp_path):
    from lumenfold.sources import files

    eye = [[1.0, 0.0, 0.0, 0.0]] * 4
    cams = spark.createDataFrame([(c, n, f"{c}{n}", eye[:3], eye) for c in "ab" for n in (2, 0, 1)], "capture string, view_id int, image string, K array<array<double>>, c2w array<array<double>>")
    docs = sinks.camera_documents(cams)
    files.write_many(docs.selectExpr("concat(capture, '/cameras.json') as name", "value as content"), str(tmp_path))
    got = {(r.capture, r.view_id): (r.image, r.c2w) for r in captures.cameras(spark, f"{tmp_path}/*/cameras.json", True).collect()}
    assert got == {(c, n): (f"{c}{n}", eye) for c in "ab" for n in range(3)}
