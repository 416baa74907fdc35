"""Vector, rotation and rigid-transform expressions: flat arithmetic that stays in generated code.

A vector is a tuple of three columns; a matrix is a tuple of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = Sequence[Sequence]

IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
# Axis conventions of capture tools and simulators.
RX_PLUS_90 = ((1.0, 0.0, 0.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0))
CAPTURE_TO_RECON = ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, -1.0, 0.0))
RECON_TO_CAPTURE = ((1.0, 0.0, 0.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0))
FLIP_YZ = (1.0, -1.0, -1.0)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def vec(x: str | Column, y: str | Column, z: str | Column) -> Vec:
    return tuple(F.col(c) if isinstance(c, str) else c for c in (x, y, z))


def dot(a: Sequence, b: Sequence) -> Column:
    out = _c(a[0]) * _c(b[0])
    for p, q in zip(a[1:], b[1:]):
        out = out + _c(p) * _c(q)
    return out


def norm(a: Sequence) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Sequence, b: Sequence) -> Column:
    return norm([_c(p) - _c(q) for p, q in zip(a, b)])


def cross(a: Sequence, b: Sequence) -> Vec:
    a, b = [_c(x) for x in a], [_c(x) for x in b]
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(a: Sequence, eps: float = 0.0) -> Vec:
    n = norm(a) + F.lit(eps) if eps else norm(a)
    return tuple(_c(x) / n for x in a)


def rotate(m: Mat, v: Sequence) -> Vec:
    return tuple(dot(row, v) for row in m)


def apply_rigid(m: Mat, v: Sequence) -> Vec:
    """3x4 or 4x4 matrix on a point."""
    return tuple(dot(row[:3], v) + _c(row[3]) for row in list(m)[:3])


def transpose(m: Mat) -> list[list]:
    return [list(r) for r in zip(*m)]


def matmul(a: Mat, b: Mat) -> list[list[Column]]:
    cols = transpose(b)
    return [[dot(row, col) for col in cols] for row in a]


def rigid_inverse(m: Mat) -> list[list]:
    """Inverse of a rotation and translation: transposed rotation, rotated negative translation."""
    rt = transpose([row[:3] for row in list(m)[:3]])
    t = [row[3] for row in list(m)[:3]]
    return [[*row, -dot(row, t)] for row in rt]


def similarity_inverse(m: Mat, scale) -> list[list]:
    """Inverse of x -> scale * (R x + t)."""
    rt = transpose([row[:3] for row in list(m)[:3]])
    t = [row[3] for row in list(m)[:3]]
    return [[*(_c(x) / _c(scale) for x in row), -dot(row, t)] for row in rt]


def matrix_of(col: str | Column, rows: int = 4, cols: int = 4) -> list[list[Column]]:
    """Elements of a nested array column."""
    c = F.col(col) if isinstance(col, str) else col
    return [[c[i][j] for j in range(cols)] for i in range(rows)]


def matrix_of_flat(col: str | Column, column_major: bool = False, n: int = 4) -> list[list[Column]]:
    c = F.col(col) if isinstance(col, str) else col
    return [[c[(j * n + i) if column_major else (i * n + j)] for j in range(n)] for i in range(n)]


def as_array(m: Mat) -> Column:
    return F.array(*(F.array(*(_c(x) for x in row)) for row in m))


def with_alignment(df, a: Sequence, b: Sequence, out: str = "r", parallel: str = "cosine"):
    """``df`` with the nine elements, ``{out}00`` to ``{out}22``, of the rotation that takes direction ``a`` to
    direction ``b`` by the shortest arc.

    ``parallel`` picks the test for directions on one line: ``"cosine"`` treats a cosine below
    -0.999999 as opposite and turns half way about an axis across ``a``; ``"cross"`` looks at a cross
    product shorter than 1e-8, giving the identity for equal directions and a half turn for opposite
    ones. Directions, their cross product and the half-turn axis become columns one after the other,
    so that the planner computes each once instead of nesting copies of them.
    """
    n = lambda s: [F.col(f"__{out}{s}{k}") for k in range(3)]
    put = lambda df, s, v: df.withColumns({f"__{out}{s}{k}": c for k, c in enumerate(v)})
    df = put(put(df, "p", [_c(x) for x in a]), "q", [_c(x) for x in b])
    df = put(put(df, "a", unit(n("p"))), "b", unit(n("q")))
    df = put(df, "v", cross(n("a"), n("b"))).withColumn(f"__{out}c", dot(n("a"), n("b")))
    along_x = F.abs(n("a")[0]) > 0.9
    helper = (F.when(along_x, 0.0).otherwise(1.0), F.when(along_x, 1.0).otherwise(0.0), F.lit(0.0))
    df = put(df, "h", cross(n("a"), helper))
    df = put(df, "w", unit(n("h")))
    v, w, c = n("v"), n("w"), F.col(f"__{out}c")
    short = norm(v) < 1e-8
    df = df.withColumn(f"__{out}o", c < -0.999999 if parallel == "cosine" else short & (c < 0))
    df = df.withColumn(f"__{out}s", F.lit(False) if parallel == "cosine" else short & (c >= 0))
    # Cross-product matrix and its square.
    k = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    vv = dot(v, v)
    cells = {}
    for i in range(3):
        for j in range(3):
            one = F.lit(1.0 if i == j else 0.0)
            square = v[i] * v[j] - (vv if i == j else F.lit(0.0))
            arc = one + k[i][j] + square / (F.lit(1.0) + c)
            cells[f"{out}{i}{j}"] = F.when(F.col(f"__{out}s"), one).when(F.col(f"__{out}o"), 2 * w[i] * w[j] - one).otherwise(arc)
    df = df.withColumns(cells)
    return df.drop(*(c for c in df.columns if c.startswith(f"__{out}")))


def columns_matrix(out: str = "r") -> list[list[Column]]:
    return [[F.col(f"{out}{i}{j}") for j in range(3)] for i in range(3)]


def quaternion_of(m: Mat) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z) of a rotation, with w >= 0: the largest of the four squared components chooses
    the branch."""
    r = [[_c(x) for x in row] for row in m]
    tr = r[0][0] + r[1][1] + r[2][2]
    squares = [tr, r[0][0] - r[1][1] - r[2][2], r[1][1] - r[0][0] - r[2][2], r[2][2] - r[0][0] - r[1][1]]
    s = [F.sqrt(F.greatest(F.lit(0.0), 1 + q)) * 2 for q in squares]
    d = {"x": r[2][1] - r[1][2], "y": r[0][2] - r[2][0], "z": r[1][0] - r[0][1]}
    p = {"xy": r[0][1] + r[1][0], "xz": r[0][2] + r[2][0], "yz": r[1][2] + r[2][1]}
    rows = [
        (s[0] / 4, d["x"] / s[0], d["y"] / s[0], d["z"] / s[0]),
        (d["x"] / s[1], s[1] / 4, p["xy"] / s[1], p["xz"] / s[1]),
        (d["y"] / s[2], p["xy"] / s[2], s[2] / 4, p["yz"] / s[2]),
        (d["z"] / s[3], p["xz"] / s[3], p["yz"] / s[3], s[3] / 4),
    ]
    top = F.greatest(*squares)
    pick = lambda i: F.when(squares[0] == top, rows[0][i]).when(squares[1] == top, rows[1][i]).when(squares[2] == top, rows[2][i]).otherwise(rows[3][i])
    q = [pick(i) for i in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(sign * x for x in q)


def yaw_quaternion(yaw: Column) -> tuple[Column, Column, Column, Column]:
    zero = F.lit(0.0)
    return (F.cos(yaw / 2), zero, zero, F.sin(yaw / 2))


def quaternion_unit(q: Sequence) -> tuple[Column, ...]:
    n = norm(q)
    return tuple(_c(x) / n for x in q)


def heading(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)
