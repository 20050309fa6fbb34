"""STL and OBJ meshes as vertex and index rows; sinks keep only what the format can hold."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERTICES = "uri string, prim_id int, vtx long, x float, y float, z float, material string"
#: Up axis and metres per unit that the formats imply.
CONVENTIONS = {"stl": ("Z", 0.001), "obj": ("Y", 1.0)}


class TopologyError(ValueError):
    """A primitive that the format cannot hold."""


def read_stl(data: bytes) -> list[tuple[str, np.ndarray]]:
    """(material, triangles n x 3 x 3): binary if the size fits its own count, else text."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        raw = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        return [("", raw["v"])]
    points = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
    return [("", np.array(points, "S").astype(np.float32).reshape(-1, 3, 3))]


def write_stl(triangles: np.ndarray) -> bytes:
    if triangles.ndim != 3 or triangles.shape[1:] != (3, 3):
        raise TopologyError("STL holds triangles only")
    raw = np.zeros(len(triangles), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    raw["v"] = triangles
    normal = np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0])
    raw["n"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-30)
    return b"\0" * 80 + struct.pack("<I", len(raw)) + raw.tobytes()


def read_obj(data: bytes) -> list[tuple[str, np.ndarray]]:
    """One primitive per run of a material; polygons become fans."""
    points, out, material, faces = [], [], "", []
    for line in data.decode("utf-8", "replace").splitlines():
        word, *rest = line.split() or [""]
        if word == "v":
            points.append([float(v) for v in rest[:3]])
        elif word == "f":
            at = [int(v.split("/")[0]) for v in rest]
            at = [i - 1 if i > 0 else len(points) + i for i in at]
            faces += [[at[0], at[i], at[i + 1]] for i in range(1, len(at) - 1)]
        elif word == "usemtl":
            if faces:
                out.append((material, faces))
            material, faces = " ".join(rest), []
    if faces:
        out.append((material, faces))
    table = np.array(points, np.float32).reshape(-1, 3)
    return [(m, table[np.array(f)]) for m, f in out]


def write_obj(primitives: list[tuple[str, np.ndarray]]) -> bytes:
    """Equal positions are written once, in order of first use; materials by name."""
    pool: dict[tuple, int] = {}
    body: list[str] = []
    for material, triangles in primitives:
        if material:
            body.append(f"usemtl {material}")
        for triangle in triangles.tolist():
            body.append("f " + " ".join(str(pool.setdefault(tuple(p), len(pool) + 1)) for p in triangle))
    return "\n".join([*(f"v {x!r} {y!r} {z!r}" for x, y, z in pool), *body, ""]).encode()


READERS = {"stl": read_stl, "obj": read_obj}


def decode(payloads: DataFrame, kind: str) -> DataFrame:
    """(uri, data) to VERTICES rows: three successive vertices are a triangle."""
    reader = READERS[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, (material, triangles) in enumerate(reader(data)):
                    flat = triangles.reshape(-1, 3).astype(np.float32)
                    same = lambda v, t: pa.array([v] * len(flat), t)  # noqa: E731,B023
                    yield pa.RecordBatch.from_arrays([same(uri, pa.string()), same(n, pa.int32()), pa.array(np.arange(len(flat))), *(pa.array(flat[:, i].copy()) for i in range(3)), same(material, pa.string())], names=["uri", "prim_id", "vtx", "x", "y", "z", "material"])

    return payloads.select("uri", "data").mapInArrow(read, VERTICES)


def encode(vertices: DataFrame, kind: str) -> DataFrame:
    """(uri, data): STL flattens a mesh and drops materials, OBJ keeps primitives; a file is one ordered group."""

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("prim_id", "ascending"), ("vtx", "ascending")])
        prims = np.array(rows.column("prim_id").to_pylist())
        points = np.stack([rows.column(a).to_numpy() for a in "xyz"], 1)
        materials = rows.column("material").to_pylist()
        parts = []
        for p in dict.fromkeys(prims.tolist()):
            mine = np.flatnonzero(prims == p)
            if len(mine) % 3:
                raise TopologyError(f"primitive {p} is not made of triangles")
            parts.append((materials[mine[0]], points[mine].reshape(-1, 3, 3)))
        data = write_stl(np.concatenate([t for _, t in parts])) if kind == "stl" else write_obj(parts)
        return pa.table({"uri": pa.array([key[0].as_py()]), "data": pa.array([data], pa.binary())})

    return vertices.groupBy("uri").applyInArrow(write, "uri string, data binary")


def normals(vertices: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: the area-weighted mean of the triangles that meet in a position."""
    corner = (F.col("vtx") % 3).cast("int")
    tri = vertices.withColumns({"t": F.floor(F.col("vtx") / 3), "c": corner}).groupBy("uri", "prim_id", "t")
    at = lambda a, i: F.max(F.when(F.col("c") == i, F.col(a).cast("double"))).alias(f"{a}{i}")
    faces = tri.agg(*(at(a, i) for a in "xyz" for i in range(3)))
    edge = lambda a, i: F.col(f"{a}{i}") - F.col(f"{a}0")
    cross = lambda a, b: edge(a, 1) * edge(b, 2) - edge(b, 1) * edge(a, 2)
    faces = faces.withColumns({"fx": cross("y", "z"), "fy": cross("z", "x"), "fz": cross("x", "y")}).select("uri", "prim_id", "t", "fx", "fy", "fz")
    met = vertices.withColumn("t", F.floor(F.col("vtx") / 3)).join(faces, ["uri", "prim_id", "t"])
    sums = met.groupBy("uri", "x", "y", "z").agg(*(F.sum(f"f{a}").alias(f"n{a}") for a in "xyz"))
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    unit = sums.withColumn("len", length).select("uri", "x", "y", "z", *(F.when(F.col("len") > 0, F.col(f"n{a}") / F.col("len")).otherwise(0.0).alias(f"n{a}") for a in "xyz"))
    return vertices.join(unit, ["uri", "x", "y", "z"])
