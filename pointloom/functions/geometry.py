"""Vectors as triples of columns, measurements, and camera matrices on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, functions as F

Vector = tuple[Column, Column, Column]


def columns(prefix: str) -> Vector:
    return tuple(F.col(f"{prefix}{a}") for a in "xyz")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def middle(a: Vector, b: Vector) -> Vector:
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def distance_parts(p: Vector, q: Vector, centre: Vector, normal: Vector) -> tuple[Column, Column, Column, Vector]:
    """Length, distance of p from the plane, distance of p's foot on it to q, and the foot."""
    off = dot(minus(p, centre), normal)
    foot = tuple(v - n * off for v, n in zip(p, normal, strict=True))
    return length(minus(p, q)), F.abs(off), length(minus(foot, q)), foot


def angle_degrees(p: Vector, vertex: Vector, q: Vector) -> Column:
    """Angle at the vertex; a ray of no length stays as it is, which gives 90 degrees."""

    def unit(v: Vector) -> Vector:
        n = length(v)
        return tuple(F.when(n > 1e-12, c / n).otherwise(c) for c in v)

    c = dot(unit(minus(p, vertex)), unit(minus(q, vertex)))
    return F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))))


@dataclass(frozen=True)
class Camera:
    """Perspective camera; matrices are row-major and act on column vectors."""

    position: tuple[float, float, float]
    target: tuple[float, float, float]
    up: tuple[float, float, float] = (0.0, 0.0, 1.0)
    fov: float = 60.0
    near: float = 0.1
    far: float = 5000.0
    aspect: float = 4 / 3

    def axes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Right, up and forward."""
        forward = np.subtract(self.target, self.position)
        forward = forward / np.linalg.norm(forward)
        right = np.cross(forward, self.up)
        right = right / np.linalg.norm(right)
        return right, np.cross(right, forward), forward

    def view(self) -> np.ndarray:
        right, up, forward = self.axes()
        out = np.eye(4)
        out[:3, :3] = np.stack((right, up, -forward))
        out[:3, 3] = -out[:3, :3] @ np.array(self.position)
        return out

    def projection(self) -> np.ndarray:
        t = 1 / math.tan(math.radians(self.fov) / 2)
        deep = self.near - self.far
        return np.array([[t / self.aspect, 0, 0, 0], [0, t, 0, 0], [0, 0, (self.far + self.near) / deep, 2 * self.far * self.near / deep], [0, 0, -1, 0]])

    def matrix(self) -> np.ndarray:
        return self.projection() @ self.view()

    def planes(self) -> list[tuple[float, float, float, float]]:
        """Left, right, bottom, top, near and far; a x + b y + c z + d is at least 0 inside."""
        m = self.matrix()
        return [tuple(float(v) for v in m[3] + s * m[k]) for k in range(3) for s in (1, -1)]

    def factor(self, height: int) -> float:
        """Pixels that a unit of length takes at a unit of distance."""
        return height / (2 * math.tan(math.radians(self.fov) / 2))

    @staticmethod
    def fitting(low: tuple[float, float, float], high: tuple[float, float, float], direction: tuple[float, float, float] = (0.0, 1.0, 0.0), **options) -> Camera:
        """Looks along direction at the middle of a box, from where its surrounding sphere fits the view."""
        centre = np.add(low, high) / 2
        radius = float(np.linalg.norm(np.subtract(high, low)) / 2)
        probe = Camera((0, 0, 0), (0, 1, 0), **options)
        half = math.radians(probe.fov) / 2
        half = min(half, math.atan(math.tan(half) * probe.aspect))
        back = centre - np.array(direction) / np.linalg.norm(direction) * radius / math.tan(half)
        return Camera(tuple(map(float, back)), tuple(map(float, centre)), **options)

    def zoomed(self, steps: float) -> Camera:
        """Nearer to the target by 0.85 a step, or farther by 1.18 a step under 0; from 0.5 to 5,000 away."""
        offset = np.subtract(self.position, self.target)
        size = np.linalg.norm(offset)
        wanted = min(max(size * (0.85**steps if steps >= 0 else 1.18**-steps), 0.5), 5000.0)
        return replace(self, position=tuple(map(float, np.add(self.target, offset * (wanted / size)))))

    def orbited(self, around: float, over: float) -> Camera:
        """Turned about the target, in degrees: around the up axis, then over the right one; the distance stays."""
        right = self.axes()[0]
        offset = turned(np.subtract(self.position, self.target), self.up, around)
        offset = turned(offset, turned(right, self.up, around), over)
        up = turned(turned(np.array(self.up, float), self.up, around), turned(right, self.up, around), over) if over else np.array(self.up)
        return replace(self, position=tuple(map(float, np.add(self.target, offset))), up=tuple(map(float, up)))

    def panned(self, right: float, up: float) -> Camera:
        """Position and target moved across the view."""
        r, u, _ = self.axes()
        move = right * r + up * u
        return replace(self, position=tuple(map(float, np.add(self.position, move))), target=tuple(map(float, np.add(self.target, move))))

    def ray(self, column: Column, row: Column, width: int, height: int) -> Vector:
        """Unit direction through a pixel's middle."""
        t = math.tan(math.radians(self.fov) / 2)
        u = ((column + 0.5) / width * 2 - 1) * t * self.aspect
        v = (1 - (row + 0.5) / height * 2) * t
        right, up, forward = self.axes()
        d = tuple(F.lit(float(f)) + u * float(r) + v * float(w) for f, r, w in zip(forward, right, up, strict=True))
        n = length(d)
        return tuple(c / n for c in d)


def turned(v: np.ndarray, axis: tuple[float, float, float], degrees: float) -> np.ndarray:
    """v about an axis, by the right-hand rule."""
    k = np.array(axis, float) / np.linalg.norm(axis)
    a = math.radians(degrees)
    return v * math.cos(a) + np.cross(k, v) * math.sin(a) + k * (k @ v) * (1 - math.cos(a))


def projected(point: Vector, m: np.ndarray) -> tuple[Column, Column, Column, Column]:
    """Clip x, y, z, w of a point; summed from x to the constant, as in the SQL, since another order rounds differently."""
    return tuple(point[0] * float(m[i, 0]) + point[1] * float(m[i, 1]) + point[2] * float(m[i, 2]) + F.lit(float(m[i, 3])) for i in range(4))


def pixel(point: Vector, m: np.ndarray, width: int, height: int) -> tuple[Column, Column, Column]:
    """Column, row (from the top) and depth; meaningful where clip w is over 1e-6."""
    x, y, z, w = projected(point, m)
    return (x / w + 1) / 2 * width, (1 - y / w) / 2 * height, z / w
