"""Operators against NumPy restatements and properties."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import camera, color, linalg, names
from lumenfold.operators import cloud, fit, frames, graph, image, mesh, metrics, nn, surface, trajectory, volume

SLOW = dict(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def cloud_of(spark, xyz, first=0, **more):
    rows = pd.DataFrame({"pid": np.arange(first, first + len(xyz)), **{c: np.asarray(xyz, float)[:, i] for i, c in enumerate("xyz")}, **more})
    return spark.createDataFrame(rows) if len(rows) else spark.createDataFrame([], "pid long, x double, y double, z double")


# ---------------------------------------------------------------- frames


def choose(sharp, motion, target):
    """Keyframes of one clip from the rule: each slot of equal motion takes, of the frames around the first one whose
    running motion reaches the slot's middle, the one that sorts first by falling sharpness and rising place."""
    count = len(sharp)
    wanted = min(max(target, 1), count)
    if motion.sum() <= 1e-6 or wanted == count:
        return set(np.linspace(0, count - 1, wanted).astype(int).tolist())
    running = pd.Series(motion).cumsum()
    middles = (pd.Series(range(wanted)) + 0.5) * (motion.sum() / wanted)
    slots = pd.DataFrame({"slot": range(wanted), "centre": [min((running < m).sum(), count - 1) for m in middles]})
    pairs = slots.merge(pd.DataFrame({"frame": range(count), "sharp": sharp}), how="cross")
    near = pairs[(pairs["frame"] - pairs["centre"]).abs() <= max(1, count // (2 * wanted))]
    return set(near.sort_values(["slot", "sharp", "frame"], ascending=[True, False, True]).groupby("slot")["frame"].first().tolist())


@settings(**SLOW)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=40), min_size=1, max_size=4), st.integers(1, 15))
def test_selection(spark, clips, target):
    rows = [(v, i, float(s), float((s * 7 + i) % 5)) for v, c in enumerate(clips) for i, s in enumerate(c)]
    df = spark.createDataFrame(rows, "video long, frame_idx long, sharpness double, signal double").repartition(3)
    got = {}
    for r in frames.select_keyframes(df, frames.IngestConfig(target_frames=target)).where("selected").collect():
        got.setdefault(r.video, set()).add(r.i)
    for v, c in enumerate(clips):
        signal = np.array([(s * 7 + i) % 5 for i, s in enumerate(c)], float)
        motion = np.abs(np.diff(signal, prepend=signal[0]))
        assert got[v] == choose(np.array(c, float), motion, target)
        assert len(got[v]) <= max(1, min(target, len(c)))


def test_reasons_and_summary(spark):
    df = spark.createDataFrame([(0, i, float(s), 1.0) for i, s in enumerate([5, 1, 5, 5, 1])], "video long, frame_idx long, sharpness double, signal double")
    labelled = frames.select_keyframes(df, frames.IngestConfig(target_frames=2))
    r = [x.reason for x in labelled.orderBy("i").collect()]
    assert r == [frames.REASON_SELECTED, frames.REASON_BLUR, frames.REASON_REDUNDANT, frames.REASON_REDUNDANT, frames.REASON_BLUR_SELECTED]
    s = frames.ingest_summary(labelled).first()
    assert (s.analysed_frames, s.selected_frames, s.dropped_blur, s.dropped_redundant) == (5, 2, 1, 2)
    assert s.median_sharpness == 5 and s.blur_threshold == 3.0


def test_stride(spark):
    df = spark.createDataFrame([(0, i, 1.0, float(i)) for i in range(10)], "video long, frame_idx long, sharpness double, signal double")
    rows = frames.frame_stats(df, fps=10.0, stride=3).orderBy("i").collect()
    assert [r.frame_idx for r in rows] == [0, 3, 6, 9] and [r.motion for r in rows] == [0, 3, 3, 3] and rows[2].time_s == 0.6


# ---------------------------------------------------------------- neighbours


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest(spark, strategy, k):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 3)), np.round(rng.normal(size=(90, 3)), 1)
    a[:5] += 50
    got = nn.k_nearest(cloud_of(spark, a), cloud_of(spark, b, 1000), k, strategy).toPandas()
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for q, g in got.groupby("qid"):
        order = np.lexsort((np.arange(90), d[q]))[:k]
        assert list(g.sort_values("rank").pid) == [1000 + o for o in order]
    assert len(got) == 60 * k


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_few_and_no_points(spark, strategy):
    none, one = cloud_of(spark, np.zeros((0, 3))), cloud_of(spark, np.ones((1, 3)), 7)
    assert nn.k_nearest(one, none, 2, strategy).count() == 0
    assert nn.k_nearest(none, one, 2, strategy).count() == 0
    assert [r.pid for r in nn.k_nearest(cloud_of(spark, np.zeros((2, 3))), one, 2, strategy).collect()] == [7, 7]
    assert nn.k_nearest(one, one, 1, strategy, skip_self=True).count() == 0


def test_gap_boxes(spark):
    """Corners of two unit boxes shifted by half: each donor corner is exactly .5 from its nearest."""
    corners = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    b, d = cloud_of(spark, corners), cloud_of(spark, corners + [0.5, 0, 0], 100)
    for s in ("broadcast", "grid"):
        assert nn.gap_points(d, b, 0.05, s).count() == 8
        assert nn.gap_points(d, b, 0.5, s).count() == 0
    diag = nn.fuse_diagnostics(d, b, 0.05).first()
    assert diag.donor_gapfill_frac == 1.0 and diag.donor_nn_median_m == 0.5 and diag.backbone_pts == diag.donor_pts == 8


@settings(**SLOW)
@given(st.integers(0, 1000), st.floats(0.01, 1.0))
def test_gap_properties(spark, seed, tau):
    rng = np.random.default_rng(seed)
    b, d = cloud_of(spark, rng.normal(size=(40, 3))), cloud_of(spark, rng.normal(size=(40, 3)), 100)
    ids = lambda t, s: {r.pid for r in nn.gap_points(d, b, t, s).collect()}
    small = ids(tau, "grid")
    assert small == ids(tau, "broadcast") and ids(2 * tau, "grid") <= small
    assert nn.gap_points(b, b, tau, "grid").count() == 0


def test_transfer_and_pairs(spark):
    a = cloud_of(spark, [[0, 0, 0], [5, 0, 0]])
    b = cloud_of(spark, [[0, 0, 1], [5, 0, 2]], 10, r=[0.1, 0.9])
    rows = {r.pid: (r.dist, r.near_r) for r in nn.transfer(a, b, ["r"]).collect()}
    assert rows == {0: (1.0, 0.1), 1: (2.0, 0.9)}
    rng = np.random.default_rng(1)
    p = rng.random((80, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    got = {(r.a, r.b) for r in nn.pairs_within(cloud_of(spark, p), 0.2).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if d[i, j] <= 0.2}


def test_chamfer_is_symmetric(spark):
    rng = np.random.default_rng(2)
    a, b = cloud_of(spark, rng.random((30, 3))), cloud_of(spark, rng.random((40, 3)))
    x, y = metrics.surface_metrics(a, b).first(), metrics.surface_metrics(b, a).first()
    assert x.chamfer_l1 == y.chamfer_l1 and x.accuracy == y.completion and x.f_score == y.f_score
    same = metrics.surface_metrics(a, a).first()
    assert same.chamfer_l1 == 0 and same.f_score == 1


# ---------------------------------------------------------------- clouds and meshes


def test_voxels_and_samples(spark):
    rng = np.random.default_rng(3)
    p = cloud_of(spark, rng.random((200, 3)))
    v = cloud.voxel_downsample(p, 0.3)
    assert v.agg(F.sum("n")).first()[0] == 200
    a = {r.pid for r in cloud.sample_exact(p, 50).collect()}
    assert len(a) == 50 and a == {r.pid for r in cloud.sample_exact(p.repartition(7), 50).collect()}
    assert cloud.sample_exact(p, 500).count() == 200
    o = {r.pid: r.ord for r in cloud.ordinal(p, "pid").collect()}
    assert o == {i: i for i in range(200)}
    e = sorted(r.pid for r in cloud.even_subsample(p, 7, "pid").collect())
    assert e == np.linspace(0, 199, 7).astype(int).tolist()
    assert cloud.even_subsample(p, 1, "pid").first().pid == 0
    assert cloud.stride(p, 50, "pid").count() == 4


def test_filters(spark):
    rng = np.random.default_rng(4)
    xyz = rng.normal(size=(300, 3))
    p = cloud_of(spark, xyz)
    d = np.linalg.norm(xyz - np.median(xyz, axis=0), axis=1)
    assert cloud.crop_flyers(p, 0.9).count() == (d < np.quantile(d, 0.9)).sum()
    assert cloud.crop_axis(p, 0.5).count() == (np.abs(xyz[:, 2] - np.median(xyz[:, 2])) < 0.5).sum()
    assert cloud.crop_axis(p, 0).count() == 300
    assert cloud.floor_band(p).count() == 300
    low = cloud.floor_drop(p, "y").agg(F.percentile("y", F.lit(0.01))).first()[0]
    assert abs(low) < 1e-12
    n = cloud.normalise_view(p).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("z") - F.min("z")).first()
    assert abs(max(n) - 3) < 1e-9
    far = np.vstack([xyz, [[40, 40, 40]]])
    kept = {r.pid for r in cloud.outlier_removal(cloud_of(spark, far), 8).collect()}
    assert 300 not in kept and len(kept) > 250


def test_pca(spark):
    rng = np.random.default_rng(5)
    xy = rng.normal(size=(500, 2)) @ np.array([[1.0, 2.0], [0.0, 0.5]])
    p = cloud_of(spark, np.column_stack([xy, np.zeros(500)]))
    r = cloud.pca_2d(p).first()
    w, v = np.linalg.eigh(np.cov(xy.T))
    assert np.allclose([r.minor, r.major], w) and np.isclose(abs(r.axis_a * v[0, 1] + r.axis_b * v[1, 1]), 1)
    a = cloud.align_2d(p).agg(F.max("ra") - F.min("ra"), F.max("rb") - F.min("rb"), F.covar_samp("ra", "rb")).first()
    assert a[0] >= a[1] and abs(a[2]) < 1e-9


def box(spark, shift=0.0, first=0):
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float) + shift
    f = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    return v, [tuple(first + k for k in t) for t in f]


def mesh_of(spark, v, t):
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double")
    return vertices, spark.createDataFrame([(i, *x) for i, x in enumerate(t)], "tid long, a long, b long, c long")


def test_mesh(spark):
    va, ta = box(spark)
    vb = np.array([[10, 0, 0], [30, 0, 0], [10, 30, 0], [30, 30, 0]], float)
    v, t = np.vstack([va, vb, [[99, 99, 99]]]), [*ta, (8, 9, 10), (9, 11, 10)]
    vertices, triangles = mesh_of(spark, v, t)
    area = sum(r.area for r in mesh.face_geometry(triangles, vertices).collect())
    assert np.isclose(area, 6 + 600)
    by_area = mesh.largest_component(triangles, vertices, "area")
    by_count = mesh.largest_component(triangles, vertices, "count")
    assert {r.tid for r in by_area.collect()} == {12, 13} and by_count.count() == 12
    assert mesh.watertight(by_count).first().watertight and not mesh.watertight(by_area).first().watertight
    small, used = mesh.drop_unreferenced(by_area, vertices)
    assert used.count() == 4 and {x for r in small.collect() for x in (r.a, r.b, r.c)} == {0, 1, 2, 3}
    n = {r.vid: (r.nx, r.ny, r.nz) for r in mesh.vertex_normals(by_area, vertices).collect()}
    assert np.allclose(n[8], (0, 0, 1)) and np.allclose(n[12], 0)
    front = mesh.cull_back_faces(by_area, mesh.vertex_normals(by_area, vertices), (20, 10, 5))
    assert front.count() == 2 and mesh.cull_back_faces(by_area, mesh.vertex_normals(by_area, vertices), (20, 10, -5)).count() == 0
    dirty = spark.createDataFrame([(0, 0, 1, 2), (1, 2, 0, 1), (2, 1, 1, 2), (3, 0, 2, 3)], "tid long, a long, b long, c long")
    assert [r.tid for r in mesh.clean_triangles(dirty).orderBy("tid").collect()] == [0, 3]
    twice, kept = mesh.merge_duplicate_vertices(*reversed(mesh_of(spark, [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0]], [(0, 1, 2), (3, 2, 1)])))
    assert kept.count() == 3 and mesh.clean_triangles(twice).count() == 1
    trimmed, left = mesh.trim_density(triangles, vertices.withColumn("density", F.col("vid") * 1.0), 0.5)
    assert left.agg(F.min("vid")).first()[0] == 6 and trimmed.count() == 2


def test_decimation_budget(spark):
    g = [(i, j) for i in range(20) for j in range(20)]
    v = [(i, j, 0.0) for i, j in g]
    t = [(20 * i + j, 20 * i + j + 1, 20 * i + 20 + j) for i in range(19) for j in range(19)]
    vertices, triangles = mesh_of(spark, v, t)
    assert mesh.decimate_by_clustering(triangles, vertices, 0)[0].count() == 361
    small, kept = mesh.decimate_by_clustering(triangles, vertices, 60)
    assert 0 < small.count() <= 60
    ids = {r.vid for r in kept.collect()}
    assert all({r.a, r.b, r.c} <= ids for r in small.collect())


def test_components_ignore_labels(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 140)]
    relabel = dict(zip(range(200), rng.permutation(200).tolist()))
    parts = lambda rows: {frozenset(g) for g in pd.DataFrame([(r.node, r.component) for r in rows]).groupby(1)[0].apply(set)}
    a = parts(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    b = parts(graph.components(spark.createDataFrame([(relabel[x], relabel[y]) for x, y in edges], "a long, b long")).collect())
    assert {frozenset(relabel[x] for x in g) for g in a} == b


# ---------------------------------------------------------------- geometry


def values(spark, cols):
    flat = [F.lit(c) if not hasattr(c, "alias") else c for row in cols for c in (row if isinstance(row, (list, tuple)) else [row])]
    return np.array(list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(flat))).first()))


@pytest.mark.parametrize("parallel", ["cosine", "cross"])
def test_alignment(spark, parallel):
    rng = np.random.default_rng(7)
    cases = [(rng.normal(size=3), rng.normal(size=3)) for _ in range(6)] + [(np.array([0, 0, 1.0]), np.array([0, 0, -1.0])), (np.array([1.0, 0, 0]), np.array([-2.0, 0, 0])), (np.array([1.0, 2, 3]), np.array([1.0, 2, 3]))]
    rows = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(cases)], "i long, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    out = linalg.with_alignment(rows, [F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)], parallel=parallel).orderBy("i").collect()
    for (a, b), r in zip(cases, out):
        m = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(m), 1)
        assert np.allclose(m @ a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-6)


def test_rigid_inverse_and_quaternion(spark):
    for m in (linalg.RX_PLUS_90, linalg.CAPTURE_TO_RECON, linalg.IDENTITY, ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), ((-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0))):
        a = np.array(m)
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and np.isclose(abs(np.linalg.det(a)), 1)
        full = [[*row, t] for row, t in zip(m, (1.0, -2.0, 3.0))]
        inv = values(spark, linalg.rigid_inverse(full)).reshape(3, 4)
        assert np.allclose(inv, np.linalg.inv(np.vstack([full, [0, 0, 0, 1]]))[:3])
        w, x, y, z = values(spark, [linalg.quaternion_of([[F.lit(v) for v in row] for row in m])])
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert w >= 0 and np.allclose(back, a, atol=1e-9)


def test_cameras(spark):
    flat = [float(k) for k in range(16)]
    m = values(spark, camera.phone_pose(F.array(*(F.lit(v) for v in flat)))).reshape(4, 4)
    want = np.arange(16.0).reshape(4, 4).T.copy()
    want[:, 1:3] *= -1
    assert np.allclose(m, want)
    k = {"fx": F.lit(50.0), "fy": F.lit(60.0), "cx": F.lit(31.0), "cy": F.lit(20.0)}
    c2w = [[*row, t] for row, t in zip(linalg.RX_PLUS_90, (1.0, 2.0, 3.0))]
    p = camera.backproject(F.lit(10.0), F.lit(12.0), F.lit(2.5), k, c2w)
    assert np.allclose(values(spark, [camera.project(p, k, linalg.rigid_inverse(c2w))]), (10, 12, 2.5))
    gl = values(spark, camera.opengl_to_opencv([[F.lit(float(4 * i + j)) for j in range(4)] for i in range(4)])).reshape(3, 4)
    assert np.allclose(gl[0], [0, -1, -2, 3])
    assert values(spark, [camera.clamp_principal(F.lit(99.0), 64), camera.clamp_principal(F.lit(-3.0), 64)]).tolist() == [62.5, 0.5]


def test_names_and_formats(spark):
    paths = ["e/a_b_m1_metrics.json", "m2_metrics.json", "/x/hall_two_metrics.json"]
    s, m = names.metric_stem(F.col("p"))
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(s.alias("s"), m.alias("m")).collect()
    assert [tuple(r) for r in got] == [("a_b", "m1"), ("scene", "m2"), ("hall", "two")]
    assert names.fixed(0.125, 2) == "0.12" and names.fixed(None, 2) == "—"
    r = spark.range(1).select(names.frame_name(F.lit(7)).alias("a"), names.swap_extension(F.lit("x/y.z/m.glb"), ".obj").alias("b")).first()
    assert tuple(r) == ("frame_0007.jpg", "x/y.z/m.obj")


def test_colours(spark):
    v = values(spark, [color.ramp(F.lit(0.03), 0.03), color.ramp(F.lit(0.09), 0.03), color.sh_decode(color.sh_encode(F.lit(0.7))), color.sigmoid(color.logit(F.lit(0.3)))])
    assert np.allclose(v, [0, 1, 0.7, 0.3])
    lut = color.turbo_table(spark).orderBy("level").collect()
    assert len(lut) == 256 and all(0 <= x <= 1 for r in lut for x in (r.r, r.g, r.b))


# ---------------------------------------------------------------- paths, images, volumes


def test_spline_and_slerp():
    t = np.array([0.0, 0.2, 0.5, 0.7, 1.0])
    cubic = np.column_stack([t**3 - t, 2 * t**2, t])
    at = np.linspace(0, 1, 21)
    assert np.allclose(trajectory.natural_spline(t, cubic, at), np.column_stack([at**3 - at, 2 * at**2, at]))
    angle = np.pi * t / 2
    q = np.column_stack([np.cos(angle / 2), 0 * t, 0 * t, np.sin(angle / 2)])
    q[2] *= -1
    got = trajectory.slerp(t, q, at)
    assert np.allclose(np.abs(got[:, 0]), np.cos(np.pi * at / 4)) and np.allclose(np.abs(got[:, 3]), np.sin(np.pi * at / 4))


def test_smooth_path(spark):
    rows = [(0, i, float(i), float(i * i), 0.0, 1.0, 0.0, 0.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "traj long, step long, x double, y double, z double, qw double, qx double, qy double, qz double")
    out = trajectory.resample_smooth(df, 11).orderBy("k").collect()
    assert len(out) == 11 and abs(out[0].x) < 1e-9 and abs(out[-1].y - 25) < 1e-9 and all(abs(r.qw - 1) < 1e-12 for r in out)


def test_generators(spark):
    assert trajectory.orbit(spark, 8, 2.0, 1.0).count() == 8
    legs = trajectory.trot(spark, 10, 0.01, 2.0, 0.3, 0.2).where("step = 3").collect()
    hip = {r.leg: r.hip for r in legs}
    assert np.isclose(hip["FL"], hip["RR"]) and np.isclose(hip["FL"], -hip["FR"])
    cells = cloud_of(spark, [[x, y, 0] for x in range(10) for y in range(10)])
    near = trajectory.goals(cells, (5, 5), 2.0, 4).collect()
    assert len(near) == 4 and all((r.x - 5) ** 2 + (r.y - 5) ** 2 <= 4 for r in near)
    assert trajectory.goals(cells, (500, 500), 2.0, 4).count() == 4


def test_images(spark):
    rng = np.random.default_rng(8)
    g = rng.random((24, 30)) * 255
    assert image.sharpness(g) > image.sharpness(image.area_resize(image.area_resize(g, 15, 12), 30, 24))
    assert np.isclose(image.area_resize(g, 7, 5).mean(), g.mean())
    assert image.sharpness(np.full((5, 5), 3.0)) == 0
    a = rng.random((20, 20))
    assert np.isclose(image.ssim(a, a), 1) and image.ssim(a, 1 - a) < 0.5 and image.photometric_loss(a, a) < 1e-12
    px = (np.stack([g, g, g], axis=2)).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(0, 0, px, 24, 30, 3), (0, 1, px, 24, 30, 3), (0, 2, bytes(24 * 30 * 3), 24, 30, 3)], "video long, frame_idx long, pixels binary, height int, width int, channels int")
    rows = image.with_motion(image.score_frames(df, proc_width=15)).orderBy("frame_idx").collect()
    assert [round(r.motion, 6) for r in rows[:2]] == [0, 0] and rows[2].motion > 50 and rows[2].sharpness == 0


def test_visibility(spark):
    cams = spark.createDataFrame([(0, 10.0, 10.0, 5.0, 5.0, 10, 10, [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]])], "view int, fx double, fy double, cx double, cy double, width int, height int, w2c array<array<double>>")
    p = cloud_of(spark, [[0, 0, 1], [0, 0, 1.01], [0, 0, 2], [0, 0, -1], [5, 0, 1]])
    assert sorted(r.pid for r in volume.visible(p, cams).collect()) == [0, 1]
    assert [r.views for r in volume.coverage(p, cams).orderBy("pid").collect()] == [1, 1, 1, 0, 0]


def test_macro_average(spark):
    rows = [("hall", "one", "C-L1", 0.015), ("attic", "one", "C-L1", 0.025), ("hall", "two", "C-L1", 0.006), ("hall", "one", "NC", 0.9)]
    table = metrics.macro_average(spark.createDataFrame(rows, "scene string, method string, metric string, value double"))
    avg = {(r.method, r.metric): r.value for r in table.where("is_total").collect()}
    assert np.isclose(avg["one", "C-L1"], 0.020) and np.isclose(avg["two", "C-L1"], 0.006)
    assert np.isclose(avg["one", "NC"], 0.45) and avg["two", "Acc"] == 0.0
    text = metrics.markdown(metrics.collate_table(table))
    assert "| AVG | one |" in text and "—" in text and "2.00" in text


# ---------------------------------------------------------------- fits


def test_planes_and_floor(spark):
    rng = np.random.default_rng(9)
    turn = np.array([[1, 0, 0], [0, np.cos(0.1), -np.sin(0.1)], [0, np.sin(0.1), np.cos(0.1)]])
    floor = np.column_stack([rng.random((600, 2)) * 4, rng.normal(0, 0.004, 600)])
    walls = rng.random((200, 3)) * [4, 4, 2.5] + [0, 0, 0.4]
    p = cloud_of(spark, np.vstack([floor, walls]) @ turn.T + [1, 2, 3])
    n, d, votes = fit.ransac_plane(p, iterations=300, up=(0, 0, 1))
    assert np.allclose(n, turn[:, 2], atol=0.01) and votes >= 590
    level = fit.align_floor(p).orderBy("pid").toPandas()
    assert np.abs(level.z[:600]).max() < 0.05 and level.z[600:].min() > 0.2
    with pytest.raises(ValueError):
        fit.ransac_plane(cloud_of(spark, [[0, 0, 0], [1, 1, 1]]))
    with pytest.raises(ValueError):
        fit.ransac_plane(cloud_of(spark, [[k, k, k] for k in range(9)]))


def test_gravity(spark):
    a = np.array([[0.0, -1, 0], [0, 0, -1], [1, 0, 0]])
    cams = spark.createDataFrame([([[float(x) for x in row] + [0.0] for row in a],)], "c2w array<array<double>>")
    out = fit.gravity_align(cloud_of(spark, [[0, 0, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0]]), cams).toPandas()
    up = -a[:, 1]
    want = np.array([[0, 0, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0]]) @ up
    assert np.allclose(out.sort_values("pid").y - out.sort_values("pid").y.iloc[0], want, atol=1e-9)


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_normals(spark, strategy):
    rng = np.random.default_rng(10)
    xyz = np.column_stack([rng.random((150, 2)), np.zeros(150)]) @ np.array([[1, 0, 0], [0, 0.6, 0.8], [0, -0.8, 0.6]])
    got = fit.estimate_normals(cloud_of(spark, xyz), 12, strategy, toward=(0, -10, 10)).toPandas()
    assert np.allclose(got[["nx", "ny", "nz"]], [0, -0.8, 0.6], atol=1e-6)


def test_work_list_and_second_pass(spark):
    assert fit.work_list(["a"], ["b"], [5], spark).first().target == 5
    with pytest.raises(ValueError):
        fit.work_list(["a"], [], [5], spark)
    df = spark.createDataFrame([(0, i, b"x") for i in range(5)], "video long, frame_idx long, pixels binary")
    chosen = spark.createDataFrame([(0, 1), (0, 3), (0, 3)], "video long, frame_idx long")
    assert [r.frame_idx for r in frames.take_selected(df, chosen).orderBy("frame_idx").collect()] == [1, 3]


def test_quantiles_without_a_column_in_one_task(spark, monkeypatch):
    """Ties, heavy tails, nulls and shares at the ends, against NumPy."""
    from lumenfold.operators import quantiles

    rng = np.random.default_rng(0)
    n = 4000
    cols = {"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.exp(rng.normal(size=n) * 40), "d": np.r_[np.zeros(n - 5), -7.0, 1.0, 2.0, 3.0, 1e300], "e": np.full(n, 2.5)}
    rows = [(*(float(v[i]) for v in cols.values()), None if i % 3 else float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    shares = [0.0, 0.005, 0.25, 0.5, 0.9, 0.9991, 1.0]
    want = {c: np.quantile(v, shares) for c, v in cols.items()} | {"f": np.quantile(np.arange(0, n, 3.0), shares)}
    for small, keep, accuracy in ((10**6, 10, 100), (10, 50, 20), (10, 1, 100)):
        for name, value in (("SMALL", small), ("KEEP", keep), ("ACCURACY", accuracy)):
            monkeypatch.setattr(quantiles, name, value)
        got = quantiles.row(df, **{c: (c, shares) for c in want}, one=("a", 0.5), none=(F.lit(None), 0.5)).first()
        for c in want:
            assert np.allclose(got[c], want[c], rtol=1e-12), c
        assert abs(got["one"] - np.median(cols["a"])) < 1e-12 and got["none"] is None


def test_exact_sample_of_a_thinned_table(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "pid")
    got = [r.pid for r in cloud.sample_exact(rows, 300, seed=4).collect()]
    assert got == [r.pid for r in rows.orderBy(F.md5(F.concat_ws(":", F.lit("4"), F.col("pid").cast("string"))), "pid").limit(300).collect()]
    assert cloud.sample_exact(rows, 0).count() == 0 and cloud.sample_exact(rows.limit(5), 9).count() == 5


def test_surface_of_a_sphere(spark):
    rng = np.random.default_rng(0)
    n = rng.normal(size=(1500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    p = cloud_of(spark, n, **{f"n{c}": n[:, i] for i, c in enumerate("xyz")})
    v, t = surface.fit_surface(p, 0.2)
    r = v.select(F.sqrt(F.expr("x * x + y * y + z * z")).alias("r")).toPandas()["r"]
    assert abs(r - 1).max() < 0.05 and v.agg(F.min("density")).first()[0] > 0
    assert mesh.watertight(t).first()["watertight"]
    faces = mesh.face_geometry(t, v)
    assert abs(faces.agg(F.sum("area")).first()[0] - 4 * np.pi) < 0.5
    out = faces.join(v.withColumnRenamed("vid", "a"), "a").agg(F.min(F.expr("nx * x + ny * y + nz * z"))).first()[0]
    assert out > 0.8
    assert 0.02 < surface.spacing(p) < 0.1


def test_iso_surface_of_a_distance_volume(spark):
    """A plane between voxel centres, on both sides of zero."""
    rows = [(x, y, z, (z + 0.5) * 0.5 - 0.1 * x, 1.0) for x in range(-3, 4) for y in range(-3, 4) for z in range(-3, 4)]
    nodes = spark.createDataFrame(rows, "ix long, iy long, iz long, value double, weight double")
    v, t = surface.iso_surface(nodes, 0.5, 0.5)
    err = v.select(F.abs(F.col("z") - 0.1 * (F.col("x") / 0.5 - 0.5)).alias("e")).agg(F.max("e")).first()[0]
    assert err < 1e-9 and t.count() > 50
    assert surface.iso_surface(nodes.where("ix > 100"), 0.5)[1].count() == 0
    with pytest.raises(ValueError):
        list(surface.cut_cubes(np.array([[1 << 20, 0, 0]]), np.array([[-1.0] + [1.0] * 7]), np.ones((1, 8)), 1.0))


def test_spline_against_a_dense_solve():
    """The banded elimination against the full system of the same conditions."""
    rng = np.random.default_rng(4)
    for n in (4, 5, 9, 40):
        t = np.cumsum(rng.random(n) + 0.1)
        y = rng.normal(size=(n, 3))
        h, slope = np.diff(t), np.diff(y, axis=0) / np.diff(t)[:, None]
        a, rhs = np.zeros((n, n)), np.zeros((n, 3))
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            rhs[i] = 6 * (slope[i] - slope[i - 1])
        a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
        m = np.linalg.solve(a, rhs)
        at = np.linspace(t[0], t[-1], 77)
        i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
        u, w, d = (at - t[i])[:, None], (t[i + 1] - at)[:, None], h[i][:, None]
        want = (m[i] * w**3 + m[i + 1] * u**3) / (6 * d) + (y[i] / d - m[i] * d / 6) * w + (y[i + 1] / d - m[i + 1] * d / 6) * u
        assert np.allclose(trajectory.natural_spline(t, y, at), want, atol=1e-9)


def test_many_cameras_see_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = cloud_of(spark, rng.normal(size=(300, 3)))
    cams = []
    for k in range(25):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        cams.append((k, 20.0, 25.0, 15.0 + k % 3, 12.0, 32, 24, np.c_[q, rng.normal(size=3)].tolist()))
    cameras = spark.createDataFrame(cams, "view int, fx double, fy double, cx double, cy double, width int, height int, w2c array<array<double>>")
    monkeypatch.setattr(volume, "UNPRUNED", 99)
    want = sorted(map(tuple, volume.project_points(p, cameras).collect()))
    monkeypatch.setattr(volume, "UNPRUNED", 2)
    monkeypatch.setattr(volume, "CAMERAS", 4)
    assert sorted(map(tuple, volume.project_points(p, cameras).collect())) == want and len(want) > 500


def test_bounded_draws_of_goals(spark):
    cells = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(400)], "pid long, x double, y double")
    near = trajectory.goals(cells, (10.0, 10.0), 3.0, 4, seed=2)
    assert near.count() == 4 and all((r.x - 10) ** 2 + (r.y - 10) ** 2 <= 9 for r in near.collect())
    assert trajectory.goals(cells, (900.0, 900.0), 3.0, 4).count() == 4
    few = trajectory.goals(cells, (10.0, 10.0), 1.0, 4, tries=8)  # of 8 draws fewer than 4 are inside
    assert few.count() == 4


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "line", "far"])
def test_cells_of_a_broadcast_side(spark, monkeypatch, kind):
    """Through cells as by the whole scan and by the shuffled grid, ties to the smaller id."""
    rng = np.random.default_rng(3)
    pts = {
        "even": rng.random((600, 3)), "clusters": np.r_[rng.normal(size=(500, 3)) * 1e-3, rng.normal(size=(100, 3)) * 50], "copies": np.repeat(rng.random((60, 3)), 10, axis=0),
        "line": np.c_[np.arange(600.0), np.zeros(600), np.zeros(600)], "far": rng.random((600, 3)) + 1e3,
    }[kind]
    q = np.r_[pts[:40], rng.normal(size=(20, 3)) * 10]
    queries, points = cloud_of(spark, q), cloud_of(spark, pts)
    for k, skip in ((1, False), (5, True)):
        want = sorted(map(tuple, nn.k_nearest(queries, points, k, "broadcast", skip).collect()))
        monkeypatch.setattr(nn, "BRUTE", 10)
        monkeypatch.setattr(nn, "PAIRS", 3000)
        assert sorted(map(tuple, nn.k_nearest(queries, points, k, "broadcast", skip).collect())) == want
        monkeypatch.undo()
        assert sorted(map(tuple, nn.k_nearest(queries, points, k, "grid", skip).collect())) == want and len(want) == 60 * k


def test_components_finished_in_rounds_or_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame(edges, "a long, b long")
    for bound in (10**6, 15, 0):
        monkeypatch.setattr(graph, "LOCAL_EDGES", bound)
        assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0
