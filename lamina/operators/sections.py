"""Section codes: the physical section family in which a voxel was seen, as one number that a vote can group by.

Planes of one orientation share a code, shells of one axis share one, and azimuthal sections have the code of the recorded
plane next to the voxel. Everything is a column expression, so codes are made inside the scan that the vote reads.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# First code of each family, and the (horizontal, vertical, stack) axes of each base view in (x, y, t).
PLANE = 0x20000000
CYLINDER = 0x40000000
SPHERE = 0x60000000
UNKNOWN = 0x80000000
AXES = {"transverse": (0, 1, 2), "sagittal": (0, 2, 1), "coronal": (1, 2, 0)}


def plane_code(x: Column, y: Column, t: Column, tolerance: float = 1.0) -> Column:
    """Code of the orientation of a plane with this normal, in bins of ``tolerance`` degrees; null for a zero or unknown vector.

    Of the two directions of a normal the one whose last nonzero component is positive counts. Azimuths of vertical planes are taken
    modulo half a turn, and horizontal planes have one code.
    """
    if not 0.01 <= tolerance <= 90:
        raise ValueError("tolerance must lie between 0.01 and 90 degrees")
    around, up = 2 * math.ceil(180 / tolerance), math.ceil(90 / tolerance)
    length = F.sqrt(x * x + y * y + t * t)
    opposite = (t < 0) | ((t == 0) & ((y < 0) | ((y == 0) & (x < 0))))
    elevation = F.rint(F.degrees(F.asin(F.least(F.abs(t) / length, F.lit(1.0)))) * (up / 90)).cast("long")
    azimuth = F.rint(F.pmod(F.degrees(F.atan2(y, x)) + F.when(opposite, 180.0).otherwise(0.0), F.lit(360.0)) * (around / 360)).cast("long") % around
    turned = F.when(elevation == 0, azimuth % (around // 2)).when(elevation == up, 0).otherwise(azimuth)
    return F.when(length > 0, F.lit(PLANE + 1) + elevation * around + turned)


def tilted_normal(base: str, degrees: float = 0.0, direction: str = "horizontal", scale: Sequence[float] = (1.0, 1.0, 1.0)) -> tuple[Column, Column, Column]:
    """Normal of a base view tilted about one of its axes; ``scale`` is the (x, y, t) ratio of processing to source grid."""
    if not abs(degrees) < 90:
        raise ValueError("a tilt lies strictly between -90 and 90 degrees")
    horizontal, vertical, stack = AXES[base]
    normal = [0.0, 0.0, 0.0]
    normal[stack] = 1.0
    normal[{"horizontal": horizontal, "vertical": vertical}[direction]] = -math.tan(math.radians(degrees))
    return tuple(F.lit(n * s) for n, s in zip(normal, scale))


def _of_nearest(horizontal: Column, vertical: Column, values: dict[float, Column]) -> Column:
    if not values:
        raise ValueError("azimuthal codes need recorded azimuths")
    place = F.degrees(F.atan2(vertical, horizontal))
    ahead = [(F.pmod(place - a, F.lit(180.0)), value) for a, value in values.items()]
    return F.array_min(F.array(*[F.struct(F.least(d, 180 - d).alias("apart"), d.alias("ahead"), v.alias("value")) for d, v in ahead]))["value"]


def nearest_azimuth(horizontal: Column, vertical: Column, recorded: Sequence[float]) -> Column:
    """Recorded azimuth (degrees, modulo 180) next to the direction of a place seen from the center; between two equal ones the lower neighbour."""
    return _of_nearest(horizontal, vertical, {a: F.lit(a) for a in (float(r) % 180 for r in recorded)})


def azimuthal_code(base: str, horizontal: Column, vertical: Column, recorded: Sequence[float], scale: Sequence[float] = (1.0, 1.0, 1.0), tolerance: float = 1.0) -> Column:
    """Code of the recorded plane next to a voxel; ``horizontal`` and ``vertical`` are counted from the center, on the axes of the base view.

    The codes of the recorded planes are constants, so a voxel costs its direction alone.
    """
    u, v, _ = AXES[base]
    codes = {}
    for a in (float(r) % 180 for r in recorded):
        normal = [0.0, 0.0, 0.0]
        normal[u], normal[v] = -math.sin(math.radians(a)) * scale[u], math.cos(math.radians(a)) * scale[v]
        codes[a] = plane_code(*[F.lit(n) for n in normal], tolerance)
    return _of_nearest(horizontal, vertical, codes)


def cylinder_code(base: str) -> Column:
    return F.lit(CYLINDER + list(AXES).index(base)).cast("long")


def sphere_code() -> Column:
    return F.lit(SPHERE).cast("long")


def unknown_code(group_key: Column) -> Column:
    """Code of a section without geometry: the checksum of its key with the top bit set."""
    return F.crc32(group_key.cast("binary")).bitwiseAND(0x1FFFFFFF).bitwiseOR(F.lit(UNKNOWN).cast("long"))
