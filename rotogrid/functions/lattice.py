"""Rotations: exact lattice rotations, Euler angles, cones, alignment, and quasi-uniform sets."""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1, 0, 0, 0, 1, 0, 0, 0, 1)


def lattice_rotations() -> list[tuple[int, ...]]:
    """The 24 proper signed permutation matrices, row-major, in lexicographic order."""
    found = []
    for axes in permutations(range(3)):
        for signs in product((-1, 1), repeat=3):
            m = np.zeros((3, 3), int)
            m[range(3), axes] = signs
            if round(np.linalg.det(m)) == 1:
                found.append(tuple(int(v) for v in m.ravel()))
    return sorted(found)


def rotate_offset(m: tuple, offset: tuple) -> tuple:
    """R . offset for row-major ``m``."""
    d = len(offset)
    return tuple(sum(m[i * d + j] * offset[j] for j in range(d)) for i in range(d))


def euler_to_matrix(angles, seq: str = "zyz") -> np.ndarray:
    """Extrinsic rotations (degrees) about the named axes, first angle first; fewer angles use the first letters."""
    out = np.eye(3)
    for angle, axis in zip(angles, seq):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        step = {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis.lower()]
        out = np.array(step) @ out
    return out


def matrix_to_euler(matrix: np.ndarray) -> np.ndarray:
    """Extrinsic zyz angles in degrees; a 2 x 2 matrix is set into 3 x 3. In gimbal lock the third angle is 0."""
    m = np.eye(3)
    matrix = np.asarray(matrix, float)
    m[: len(matrix), : len(matrix)] = matrix
    beta = math.acos(max(-1.0, min(1.0, m[2, 2])))
    if abs(math.sin(beta)) < 1e-7:
        return np.degrees([math.atan2(m[1, 0], m[0, 0]) if m[2, 2] > 0 else math.atan2(m[1, 0], -m[0, 0]), beta, 0.0])
    return np.degrees([math.atan2(m[2, 1], -m[2, 0]), beta, math.atan2(m[1, 2], m[0, 2])])


def euler_columns(a: Column, b: Column, c: Column) -> list[Column]:
    """The nine entries of the extrinsic zyz matrix of three angle columns in degrees."""
    ca, sa, cb, sb, cc, sc = F.cos(F.radians(a)), F.sin(F.radians(a)), F.cos(F.radians(b)), F.sin(F.radians(b)), F.cos(F.radians(c)), F.sin(F.radians(c))
    return [cc * cb * ca - sc * sa, -cc * cb * sa - sc * ca, cc * sb, sc * cb * ca + cc * sa, -sc * cb * sa + cc * ca, sc * sb, -sb * ca, sb * sa, cb]


def euler_of_columns(m: list[Column]) -> list[Column]:
    """Extrinsic zyz angles in degrees of nine matrix columns (away from gimbal lock)."""
    return [F.degrees(F.atan2(m[7], -m[6])), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[8])))), F.degrees(F.atan2(m[5], m[2]))]


def vector_to_matrix(vector) -> np.ndarray:
    """The rotation about a vector by its length in radians."""
    angle = float(np.linalg.norm(vector))
    if angle == 0:
        return np.eye(3)
    x, y, z = np.asarray(vector, float) / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def align_vectors(base, target=(0, 0, 1)) -> np.ndarray:
    """The smallest rotation that takes ``base`` to ``target``."""
    a, b = (np.asarray(v, float) / np.linalg.norm(v) for v in (base, target))
    axis, cos = np.cross(a, b), float(a @ b)
    if np.linalg.norm(axis) < 1e-12:
        if cos > 0:
            return np.eye(3)
        other = np.cross(a, [1, 0, 0] if abs(a[0]) < 0.9 else [0, 1, 0])
        other /= np.linalg.norm(other)
        return 2 * np.outer(other, other) - np.eye(3)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + k + k @ k / (1 + cos)


def cone_points(angle: float, sampling: float, axis=(1, 0, 0)) -> np.ndarray:
    """Unit vectors on a golden spiral within ``angle`` degrees of ``axis``, about ``sampling`` degrees apart."""
    rings = np.arange(0, angle + 1e-9, sampling)
    n = int(sum(math.ceil(360 * math.sin(math.radians(t)) / sampling) + 1 for t in rings)) + 2
    i = np.arange(n) + 0.5
    theta, phi = math.radians(angle) * np.sqrt(i / n), math.pi * (1 + math.sqrt(5)) * i
    points = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], 1)
    return points @ align_vectors((0, 0, 1), axis).T


def cone_rotations(cone_angle: float, cone_sampling: float, axis=(1, 0, 0), axis_angle: float = 360.0, axis_sampling: float | None = None, reference=(1, 0, 0), symmetry: int = 1) -> np.ndarray:
    """Rotations that take ``reference`` into the cone about ``axis``, times turns about it; symmetry shortens the turns."""
    step = axis_sampling or cone_sampling
    turns = np.arange(0, axis_angle / symmetry - 1e-9, step)
    out = []
    for point in cone_points(cone_angle, cone_sampling, axis):
        tilt = align_vectors(reference, point)
        unit = np.asarray(point)
        k = np.array([[0, -unit[2], unit[1]], [unit[2], 0, -unit[0]], [-unit[1], unit[0], 0]])
        for t in np.radians(turns):
            out.append((np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k) @ tilt)
    return np.array(out)


def uniform_rotations(sampling: float, dim: int = 3) -> np.ndarray:
    """A deterministic quasi-uniform set with about (360 / sampling)**3 / pi rotations (two interleaved spirals on the
    quaternion sphere); evenly spaced angles in the plane. The first is the identity."""
    if dim == 2:
        t = np.radians(np.arange(0, 360 - 1e-9, sampling))
        return np.stack([np.stack([np.cos(t), -np.sin(t)], -1), np.stack([np.sin(t), np.cos(t)], -1)], 1)
    n = max(1, int(round((360 / sampling) ** 3 / math.pi)))
    psi = 1.533751168755204288118041413
    s = np.arange(n) + 0.5
    t = s / n
    r, R = np.sqrt(t), np.sqrt(1 - t)
    a, b = 2 * math.pi * s / math.sqrt(2), 2 * math.pi * s / psi
    x, y, z, w = r * np.sin(a), r * np.cos(a), R * np.sin(b), R * np.cos(b)
    m = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1).reshape(n, 3, 3)
    return np.concatenate([np.eye(3)[None], m[0].T @ m[1:]])


def sampling_of_diameter(diameter: float, rate: float, lowpass: float = 0.0) -> float:
    """Angular sampling (degrees) that a particle of ``diameter`` needs at the coarser of Nyquist and low-pass."""
    return 360 * max(2 * rate, lowpass) / (math.pi * diameter)
