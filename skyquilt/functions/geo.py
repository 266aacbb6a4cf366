"""Geographic and projective column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyquilt.fixed import CHI2_95_2DOF, EARTH_RADIUS_M


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    dphi = F.radians(_c(lat2) - _c(lat1))
    dlam = F.radians(_c(lon2) - _c(lon1))
    s1, s2 = F.sin(dphi / 2), F.sin(dlam / 2)
    return s1 * s1 + F.cos(F.radians(_c(lat1))) * F.cos(F.radians(_c(lat2))) * s2 * s2


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, atan2 form, (lat, lon) order."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_lonlat_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres, asin form, (lon, lat) order."""
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def sphere_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Metres on the sphere; a chord is never longer than its arc."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    r = F.lit(EARTH_RADIUS_M)
    return r * F.cos(phi) * F.cos(lam), r * F.cos(phi) * F.sin(lam), r * F.sin(phi)


def pixel_to_geo(gt, x, y) -> Column:
    """Affine pixel -> struct(lon, lat); ``gt`` holds six coefficients."""
    g, x, y = _c(gt), _c(x), _c(y)
    return F.struct(
        (g[0] + x * g[1] + y * g[2]).alias("lon"),
        (g[3] + x * g[4] + y * g[5]).alias("lat"),
    )


def geo_to_pixel(gt, lon, lat) -> Column:
    """Inverse affine -> struct(col, row), truncated toward zero."""
    g = _c(gt)
    dx, dy = _c(lon) - g[0], _c(lat) - g[3]
    det = g[1] * g[5] - g[2] * g[4]
    return F.struct(
        ((g[5] * dx - g[2] * dy) / det).cast("int").alias("col"),
        ((g[1] * dy - g[4] * dx) / det).cast("int").alias("row"),
    )


def project(h, x, y) -> Column:
    """Homography applied to a point -> struct(x, y)."""
    m, x, y = _c(h), _c(x), _c(y)
    w = m[6] * x + m[7] * y + m[8]
    return F.struct(
        ((m[0] * x + m[1] * y + m[2]) / w).alias("x"),
        ((m[3] * x + m[4] * y + m[5]) / w).alias("y"),
    )


def error_ellipse(sxx, sxy, syy) -> Column:
    """95 % ellipse of a 2x2 covariance -> struct(minor, major, angle_deg).

    Closed form of the symmetric eigen problem. The angle pairs the y part of
    the larger eigenvector with the x part of the smaller one. An eigen solver
    leaves the signs open; here the eigenvector matrix is a rotation and the
    larger vector points to non-negative y, so the angle is 45 degrees, or 0
    when the larger vector lies on the x axis.
    """
    a, b, c = _c(sxx), _c(sxy), _c(syy)
    mean, diff = (a + c) / 2, (a - c) / 2
    root = F.sqrt(diff * diff + b * b)
    low, high = mean - root, mean + root
    y = F.when(b != 0, (high - a) / F.sqrt(b * b + (high - a) * (high - a)))
    y = y.when(a > c, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.struct(
        F.sqrt(low * CHI2_95_2DOF).alias("minor"),
        F.sqrt(high * CHI2_95_2DOF).alias("major"),
        (F.atan2(y, y) * (180 / math.pi)).alias("angle_deg"),
    )


def matmul3(a: Column, b: Column) -> Column:
    """Row-major 3x3 product."""
    return F.array(
        *[
            a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
            for i in range(3)
            for j in range(3)
        ]
    )


def bound(fn, *values: Column) -> Column:
    """``fn`` of values that are computed once, however often it names them (a plan would repeat their expressions)."""
    one = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(one), lambda s: fn(*[s[f"v{i}"] for i in range(len(values))]))[0]


def inverse3(a: Column) -> Column:
    """Row-major 3x3 inverse by cofactors; null where the determinant is 0."""
    def minor(m: Column, r: int, c: int) -> Column:
        i, j = [k for k in range(3) if k != r], [k for k in range(3) if k != c]
        d = m[3 * i[0] + j[0]] * m[3 * i[1] + j[1]] - m[3 * i[0] + j[1]] * m[3 * i[1] + j[0]]
        return d if (r + c) % 2 == 0 else -d

    def inverse(m: Column) -> Column:
        det = m[0] * minor(m, 0, 0) + m[1] * minor(m, 0, 1) + m[2] * minor(m, 0, 2)
        return bound(lambda m, d: F.when(d != 0, F.array(*[minor(m, j, i) / d for i in range(3) for j in range(3)])), m, det)

    return bound(inverse, a)


IDENTITY3 = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
