"""Axis-aligned boxes, points and shape estimates as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_VOLUME = 1e-10
POINT_TOLERANCE = 1e-9
NORMAL_TOLERANCE = 1e-8


@dataclass(frozen=True)
class Point:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def at(x: float, y: float, z: float) -> "Point":
        return Point(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def axes(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def plus(self, other: "Point") -> "Point":
        return Point(*[a + b for a, b in zip(self.axes(), other.axes())])

    def minus(self, other: "Point") -> "Point":
        return Point(*[a - b for a, b in zip(self.axes(), other.axes())])

    def times(self, k: Column) -> "Point":
        return Point(*[a * k for a in self.axes()])

    def over(self, k: Column) -> "Point":
        return Point(*[F.try_divide(a, k) for a in self.axes()])

    def magnitude(self) -> Column:
        return F.sqrt(self.x * self.x + self.y * self.y + self.z * self.z)

    def distance(self, other: "Point") -> Column:
        return self.minus(other).magnitude()

    def normalized(self) -> "Point":
        """Unit vector; the origin for vectors shorter than 1e-10."""
        size = self.magnitude()
        return Point(*[F.when(size < 1e-10, 0.0).otherwise(F.try_divide(a, size)) for a in self.axes()])

    def unit_normal(self) -> "Point":
        """Unit vector; vectors no longer than 1e-8 stay as they are."""
        size = self.magnitude()
        return Point(*[F.when(size > NORMAL_TOLERANCE, F.try_divide(a, size)).otherwise(a) for a in self.axes()])

    def midpoint(self, other: "Point") -> "Point":
        return Point(*[(a + b) * 0.5 for a, b in zip(self.axes(), other.axes())])

    def lerp(self, other: "Point", t: Column) -> "Point":
        return Point(*[a + (b - a) * t for a, b in zip(self.axes(), other.axes())])

    def same_as(self, other: "Point") -> Column:
        dx, dy, dz = [F.abs(a - b) < POINT_TOLERANCE for a, b in zip(self.axes(), other.axes())]
        return dx & dy & dz


@dataclass(frozen=True)
class Box:
    """Six columns; ``Box.of("a_")`` reads ``a_min_x`` … ``a_max_z``."""

    lo: Point
    hi: Point

    @staticmethod
    def of(prefix: str = "") -> "Box":
        lo = Point(*[F.col(f"{prefix}min_{a}") for a in "xyz"])
        hi = Point(*[F.col(f"{prefix}max_{a}") for a in "xyz"])
        return Box(lo, hi)

    @staticmethod
    def literal(*bounds: float) -> "Box":
        return Box(Point.at(*bounds[:3]), Point.at(*bounds[3:]))

    def columns(self, prefix: str = "") -> list[Column]:
        lo = [c.alias(f"{prefix}min_{a}") for c, a in zip(self.lo.axes(), "xyz")]
        hi = [c.alias(f"{prefix}max_{a}") for c, a in zip(self.hi.axes(), "xyz")]
        return lo + hi

    def present(self) -> Column:
        """All six bounds are known."""
        test = F.lit(True)
        for bound in (*self.lo.axes(), *self.hi.axes()):
            test = test & bound.isNotNull()
        return test

    def size(self) -> Point:
        return self.hi.minus(self.lo)

    def centroid(self) -> Point:
        return self.lo.midpoint(self.hi)

    def volume(self) -> Column:
        s = self.size()
        return F.abs(s.x * s.y * s.z)

    def surface(self) -> Column:
        s = self.size()
        return (s.x * s.y + s.y * s.z + s.z * s.x) * 2.0

    def diagonal(self) -> Column:
        return self.lo.distance(self.hi)

    def is_valid(self) -> Column:
        x, y, z = [a <= b for a, b in zip(self.lo.axes(), self.hi.axes())]
        return x & y & z

    def is_empty(self) -> Column:
        return self.volume() < EMPTY_VOLUME

    def union(self, other: "Box") -> "Box":
        return Box(
            Point(*[F.least(a, b) for a, b in zip(self.lo.axes(), other.lo.axes())]),
            Point(*[F.greatest(a, b) for a, b in zip(self.hi.axes(), other.hi.axes())]),
        )

    def intersection(self, other: "Box") -> "Box":
        """Common part; NULL bounds when the boxes are disjoint."""
        hit = self.intersects(other)
        return Box(
            Point(*[F.when(hit, F.greatest(a, b)) for a, b in zip(self.lo.axes(), other.lo.axes())]),
            Point(*[F.when(hit, F.least(a, b)) for a, b in zip(self.hi.axes(), other.hi.axes())]),
        )

    def expand(self, amount: Column) -> "Box":
        return Box(Point(*[a - amount for a in self.lo.axes()]), Point(*[a + amount for a in self.hi.axes()]))

    def include(self, p: Point) -> "Box":
        return self.union(Box(p, p))

    def contains_point(self, p: Point) -> Column:
        tests = [(v >= a) & (v <= b) for v, a, b in zip(p.axes(), self.lo.axes(), self.hi.axes())]
        return tests[0] & tests[1] & tests[2]

    def contains_box(self, other: "Box") -> Column:
        return self.contains_point(other.lo) & self.contains_point(other.hi)

    def intersects(self, other: "Box") -> Column:
        tests = [
            (b_hi >= a_lo) & (b_lo <= a_hi)
            for a_lo, a_hi, b_lo, b_hi in zip(
                self.lo.axes(), self.hi.axes(), other.lo.axes(), other.hi.axes()
            )
        ]
        return tests[0] & tests[1] & tests[2]

    def distance(self, other: "Box") -> Column:
        """Euclidean gap; 0 when the boxes touch or overlap."""
        gaps = [
            F.greatest(F.lit(0.0), a_lo - b_hi, b_lo - a_hi)
            for a_lo, a_hi, b_lo, b_hi in zip(
                self.lo.axes(), self.hi.axes(), other.lo.axes(), other.hi.axes()
            )
        ]
        return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])

    def adjacent(self, other: "Box", tolerance: Column) -> Column:
        return self.distance(other) <= tolerance

    def overlap_volume(self, other: "Box") -> Column:
        sides = [
            F.greatest(F.lit(0.0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo))
            for a_lo, a_hi, b_lo, b_hi in zip(
                self.lo.axes(), self.hi.axes(), other.lo.axes(), other.hi.axes()
            )
        ]
        return sides[0] * sides[1] * sides[2]


# Tolerance in metres by category key, in declaration order.
CATEGORY_TOLERANCES = {
    "Pipe": 0.05,
    "Piping": 0.05,
    "Equipment": 0.10,
    "Structure": 0.20,
    "Structural": 0.20,
    "Insulation": 0.01,
    "HVAC": 0.08,
    "Electrical": 0.05,
    "Cable Tray": 0.05,
    "Instrument": 0.03,
}
DEFAULT_TOLERANCE = 0.15


def tolerance(category: Column) -> Column:
    """Exact key first, then the first key found inside the category."""
    low = F.lower(category)
    chain = F.when(category.isNull() | (category == ""), F.lit(DEFAULT_TOLERANCE))
    for key, value in CATEGORY_TOLERANCES.items():
        chain = chain.when(low == key.lower(), F.lit(value))
    for key, value in CATEGORY_TOLERANCES.items():
        chain = chain.when(F.contains(low, F.lit(key.lower())), F.lit(value))
    return chain.otherwise(F.lit(DEFAULT_TOLERANCE))


def relation(distance: Column, overlap: Column) -> Column:
    return (
        F.when(overlap > 1e-9, F.lit("overlap"))
        .when(distance < 1e-4, F.lit("touch"))
        .otherwise(F.lit("neartouch"))
    )


def shape_hint(box: Box, name: Column) -> Column:
    """Disc, Plate, Cylinder or Box from the name or the sorted side ratios."""
    s = box.size()
    sides = F.array_sort(F.array(s.x, s.y, s.z))
    small, mid, large = sides[0], sides[1], sides[2]
    wide = F.try_divide(mid, large) > 0.6
    thinness = F.when(mid > 1e-9, F.try_divide(small, mid)).otherwise(F.lit(0.0))
    low = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(F.startswith(low, F.lit("flange")), F.lit("Disc"))
        .when(F.contains(low, F.lit("plate")), F.lit("Plate"))
        .when(large < 1e-9, F.lit("Box"))
        .when(wide & (thinness < 0.5), F.lit("Disc"))
        .when(wide, F.lit("Cylinder"))
        .when(thinness < 0.3, F.lit("Plate"))
        .otherwise(F.lit("Box"))
    )


def cylinder_fit(box: Box) -> Column:
    """Struct of axis (0..2, the shortest side), radius and height."""
    s = box.size()
    sides = F.array_sort(
        F.array(*[F.struct(c.alias("side"), F.lit(i).alias("axis")) for i, c in enumerate(s.axes())])
    )
    return F.struct(
        sides[0]["axis"].alias("axis"),
        ((sides[1]["side"] + sides[2]["side"]) / 4.0).alias("radius"),
        sides[0]["side"].alias("height"),
    )


def transform_point(p: Point, matrix: list[Column]) -> Point:
    """Column-major 4×4 affine transform."""
    rows = [
        matrix[r] * p.x + matrix[r + 4] * p.y + matrix[r + 8] * p.z + matrix[r + 12]
        for r in range(3)
    ]
    return Point(*rows)


def is_identity(matrix: list[Column]) -> Column:
    test = F.lit(True)
    for i, cell in enumerate(matrix):
        test = test & (F.abs(cell - (1.0 if i % 5 == 0 else 0.0)) <= 1e-6)
    return test


def gap_flags(item: Box, vertices: Box) -> dict[str, Column]:
    """Faces where the object box exceeds the vertex box by more than max(1 %, 0.01)."""
    flags = {}
    axes = zip("xyz", item.size().axes(), item.lo.axes(), item.hi.axes(), vertices.lo.axes(), vertices.hi.axes())
    for axis, side, i_lo, i_hi, v_lo, v_hi in axes:
        limit = F.greatest(side * 0.01, F.lit(0.01))
        flags[f"gap_max_{axis}"] = (i_hi - v_hi) > limit
        flags[f"gap_min_{axis}"] = (v_lo - i_lo) > limit
    return flags
