"""Drawn meshes and splats against plain Python versions, a pixel at a time."""

import math

import numpy as np
import pytest

from lumenfold.operators import raster

CAM = "view int, fx double, fy double, cx double, cy double, width int, height int, w2c array<array<double>>"
SIZE = 12


def cameras(spark, *extra):
    eye = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    turned = [[0.0, 0.0, 1.0, 0.1], [0.0, 1.0, 0.0, -0.1], [-1.0, 0.0, 0.0, 4.0]]
    rows = [(0, 10.0, 9.0, 6.0, 5.5, SIZE, SIZE - 2, eye), (1, 8.0, 8.0, 5.0, 5.0, SIZE, SIZE, turned), *extra]
    return spark.createDataFrame(rows, CAM), rows


def placed(cam, p):
    m = np.array(cam[7])
    q = m[:, :3] @ p + m[:, 3]
    return q, (cam[1] * q[0] / q[2] + cam[3], cam[2] * q[1] / q[2] + cam[4])


def test_mesh_against_every_pixel(spark):
    rng = np.random.default_rng(0)
    v = np.c_[rng.uniform(-1.5, 1.5, (40, 2)), rng.uniform(1.0, 4.0, 40)]
    v[0, 2] = -1.0  # behind the first camera
    t = [tuple(map(int, rng.choice(40, 3, replace=False))) for _ in range(25)] + [(5, 5, 6)]
    shade = rng.uniform(size=40)
    vertices = spark.createDataFrame([(i, *map(float, p), float(s)) for i, (p, s) in enumerate(zip(v, shade))], "vid long, x double, y double, z double, shade double")
    triangles = spark.createDataFrame([(i, *c) for i, c in enumerate(t)], "tid long, a long, b long, c long")
    df, cams = cameras(spark)
    want = {}
    for cam in cams:
        for tid, tri in enumerate(t):
            at = [placed(cam, v[k]) for k in tri]
            z = np.array([q[2] for q, _ in at])
            if (z <= raster.NEAR).any():
                continue
            m = np.array([[*uv, 1.0] for _, uv in at]).T
            if abs(np.linalg.det(m)) < 1e-12:
                continue
            for py in range(cam[6]):
                for px in range(cam[5]):
                    w = np.linalg.solve(m, [px + 0.5, py + 0.5, 1.0])
                    if (w >= 0).all():
                        near = (w / z).sum()
                        new = (1 / near, tid, (w * shade[list(tri)] / z).sum() / near)
                        want[cam[0], px, py] = min(want.get((cam[0], px, py), new), new)
    got = {(r.view, r.px, r.py): (r.depth, r.tid, r.shade) for r in raster.draw_mesh(triangles, vertices, df, ("shade",)).collect()}
    assert got.keys() == want.keys() and len({k[0] for k in got}) == 2 and len(got) > 40
    for k, (depth, tid, s) in want.items():
        assert got[k][1] == tid and math.isclose(got[k][0], depth, rel_tol=1e-9) and math.isclose(got[k][2], s, rel_tol=1e-9)


SPLAT = "pid long, x double, y double, z double, s0 double, s1 double, s2 double, qw double, qx double, qy double, qz double, opacity double, r double, g double, b double"


def turn_of(q):
    """Rotation by its axes: a vector turned by the quaternion product."""
    w, x, y, z = q
    u = np.array([x, y, z])
    return np.stack([2 * (u @ e) * u + (w * w - u @ u) * e + 2 * w * np.cross(u, e) for e in np.eye(3)], axis=1)


def test_splats_against_every_pixel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        rows.append((i, *map(float, rng.uniform(-1, 1, 2)), float(rng.uniform(-0.5, 3)), *map(float, rng.uniform(0.02, 0.4, 3)), *map(float, q), float(rng.uniform(0.0, 1.0)), *map(float, rng.uniform(size=3))))
    rows += [(100 + i, 0.05, 0.0, 1.5, 0.6, 0.6, 0.6, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.5, 0.0) for i in range(6)]  # opaque, one behind the other
    df, cams = cameras(spark)
    want = {}
    for cam in cams:
        drawn = []
        for row in rows:
            q, (u, v) = placed(cam, np.array(row[1:4]))
            if q[2] <= raster.NEAR:
                continue
            spread = turn_of(row[7:11]) @ np.diag(np.square(row[4:7])) @ turn_of(row[7:11]).T
            m = np.array(cam[7])[:, :3]
            jac = np.array([[cam[1] / q[2], 0, -cam[1] * q[0] / q[2] ** 2], [0, cam[2] / q[2], -cam[2] * q[1] / q[2] ** 2]])
            cov = jac @ m @ spread @ m.T @ jac.T + raster.BLUR * np.eye(2)
            drawn.append((q[2], row[0], u, v, cov, row[11], np.array(row[12:15])))
        for py in range(cam[6]):
            for px in range(cam[5]):
                light, colour, alpha, depth = 1.0, np.zeros(3), 0.0, 0.0
                for z, _, u, v, cov, opacity, c in sorted(drawn, key=lambda d: d[:2]):
                    d = np.array([px + 0.5 - u, py + 0.5 - v])
                    if abs(d).max() > raster.REACH * math.sqrt(np.linalg.eigvalsh(cov)[1]):
                        continue
                    a = min(raster.MOST, opacity * math.exp(-0.5 * d @ np.linalg.solve(cov, d)))
                    if a < raster.LEAST or light < raster.DARK:
                        continue
                    colour, alpha, depth, light = colour + c * a * light, alpha + a * light, depth + z * a * light, light * (1 - a)
                if alpha:
                    want[cam[0], px, py] = (*colour, alpha, depth / alpha)
    got = {(r.view, r.px, r.py): tuple(r)[3:] for r in raster.draw_splats(spark.createDataFrame(rows, SPLAT), df).collect()}
    assert got.keys() == want.keys() and len(got) > 60
    assert all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-9) for k in want)


def test_nothing_to_draw(spark):
    df, _ = cameras(spark)
    empty = spark.createDataFrame([], SPLAT)
    assert raster.draw_splats(empty, df).count() == 0
    vertices = spark.createDataFrame([(0, 0.0, 0.0, -5.0), (1, 1.0, 0.0, -5.0), (2, 0.0, 1.0, -5.0)], "vid long, x double, y double, z double")
    triangles = spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long")
    assert raster.draw_mesh(triangles, vertices, df.where("view = 0")).count() == 0
    with pytest.raises(ValueError, match="cameras"):
        raster.draw_mesh(triangles, vertices, df.crossJoin(spark.range(1_500).select("id")))
