"""Angles, vectors and rotations as column expressions; a vector is a tuple of three columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.78
Vector = tuple[Column, Column, Column]


def wrap_pi(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def wrap_180(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def wrap_2pi(x: Column) -> Column:
    return F.pmod(x, F.lit(2 * math.pi))


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def axis_map(v: Vector, name: str) -> Vector:
    """Sensor axes to body axes: right-front-up to front-right-down, a quarter turn about z, or none."""
    x, y, z = v
    maps = {"identity": (x, y, z), "rfu_to_frd": (y, x, -z), "rotz_p90": (-y, x, z)}
    if name not in maps:
        raise ValueError(f"unknown axis map {name}; known: {sorted(maps)}")
    return maps[name]


def rotation(roll: Column, pitch: Column, yaw: Column) -> tuple[Vector, Vector, Vector]:
    """Rows of Rz(yaw) Ry(pitch) Rx(roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return (
        (cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr),
        (sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr),
        (-sp, cp * sr, cp * cr),
    )


def rotate(rows: tuple[Vector, Vector, Vector], v: Vector) -> Vector:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in rows)  # type: ignore[return-value]


def angles_of(rows: tuple[Vector, Vector, Vector], eps: float = 1e-6) -> Vector:
    """(roll, pitch, yaw) of a rotation; at the poles roll is 0 and yaw takes the rest."""
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -rows[2][0])))
    pole = F.abs(F.abs(pitch) - math.pi / 2) < eps
    roll = F.when(pole, F.lit(0.0)).otherwise(F.atan2(rows[2][1], rows[2][2]))
    yaw = F.when(pole, F.atan2(-rows[0][1], rows[1][1])).otherwise(F.atan2(rows[1][0], rows[0][0]))
    return roll, pitch, yaw


def gravity_in_body(roll: Column, pitch: Column, g: float = GRAVITY) -> Vector:
    """Gravity (0, 0, -g) of the navigation frame in body axes; yaw has no part in it."""
    return g * F.sin(pitch), -g * F.sin(roll) * F.cos(pitch), -g * F.cos(roll) * F.cos(pitch)


def linear_acceleration(force: Vector, roll: Column, pitch: Column, bias: Vector, g: float = GRAVITY) -> Vector:
    return tuple(f + d - b for f, d, b in zip(force, gravity_in_body(roll, pitch, g), bias))  # type: ignore[return-value]


def course(east: Column, north: Column) -> Column:
    """Heading of a velocity, 0 in the east. Zeros keep their sign, as in C and numpy: Spark's atan2 takes it from them."""
    below = lambda c: (c < 0) | (c.cast("string") == "-0.0")
    return F.when((north == 0) & below(east), F.when(below(north), -math.pi).otherwise(math.pi)).otherwise(F.atan2(north, east))


def speed_sigma(speed: Column, share: float, floor: float, inflate: float = 1.0) -> Column:
    """Noise of a velocity that grows with speed."""
    return F.sqrt((share * speed) * (share * speed) + floor * floor) * inflate


Quaternion = tuple[Column, Column, Column, Column]


def quaternion_product(a: Quaternion, b: Quaternion) -> Quaternion:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def quaternion_conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def quaternion_unit(q: Quaternion) -> Quaternion:
    """Length 1; the identity where the length is 0."""
    n = norm(*q)
    return tuple(F.when(n > 1e-12, p / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, p in enumerate(q))  # type: ignore[return-value]


def quaternion_of_turn(v: Vector) -> Quaternion:
    """The turn by |v| about v."""
    angle = norm(*v)
    scale = F.when(angle > 1e-12, F.sin(angle / 2) / F.greatest(angle, F.lit(1e-12))).otherwise(F.lit(0.5))
    return F.cos(angle / 2), v[0] * scale, v[1] * scale, v[2] * scale


def quaternion_rotate(q: Quaternion, v: Vector) -> Vector:
    _, x, y, z = quaternion_product(quaternion_product(q, (F.lit(0.0), *v)), quaternion_conjugate(q))
    return x, y, z


def quaternion_rows(q: Quaternion) -> tuple[Vector, Vector, Vector]:
    w, x, y, z = q
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
        (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
        (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
    )
