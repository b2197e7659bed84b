"""Tile coordinates, projections and space-filling curves as Column expressions.

Coordinates are BIGINT columns z, x, y with y growing to the south.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spherical Mercator.
EARTH_RADIUS = 6_378_137.0
WORLD = 2 * math.pi * EARTH_RADIUS
MAX_LEVEL = 30
NUDGE = 1e-10


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def _long(value: Column) -> Column:
    return value.cast("bigint")


def side(z) -> Column:
    """Tiles along one side of level z."""
    return F.pow(F.lit(2.0), _c(z))


def _within(value: Column, z) -> Column:
    return _long(F.greatest(F.lit(0.0), F.least(side(z) - 1, F.floor(value).cast("double"))))


def tile_x(lon, z) -> Column:
    return _within(side(z) * (_c(lon) / 360.0 + 0.5), z)


def tile_y(lat, z) -> Column:
    return _within(side(z) * (0.5 - 0.5 * F.log(F.tan(_c(lat) * F.pi() / 360.0 + F.pi() / 4.0)) / F.pi()), z)


def tile_west(x, z) -> Column:
    return _c(x) / side(z) * 360.0 - 180.0


def tile_north(y, z) -> Column:
    return F.atan(F.exp(F.pi() * (1.0 - 2.0 * _c(y) / side(z)))) * 360.0 / F.pi() - 90.0


def geo_bbox(z, x, y) -> Column:
    """Struct of west, south, east, north in degrees."""
    return F.struct(tile_west(x, z).alias("west"), tile_north(_c(y) + 1, z).alias("south"), tile_west(_c(x) + 1, z).alias("east"), tile_north(y, z).alias("north"))


def mercator_bbox(z, x, y) -> Column:
    """Struct of x_min, y_min, x_max, y_max in metres."""
    east = lambda v: (_c(v) / side(z) - 0.5) * WORLD
    north = lambda v: (0.5 - _c(v) / side(z)) * WORLD
    return F.struct(east(x).alias("x_min"), north(_c(y) + 1).alias("y_min"), east(_c(x) + 1).alias("x_max"), north(y).alias("y_max"))


def mercator_x(lon) -> Column:
    return _c(lon) * (math.pi / 180.0) * EARTH_RADIUS


def mercator_y(lat) -> Column:
    return F.log(F.tan(_c(lat) * F.pi() / 360.0 + F.pi() / 4.0)) * EARTH_RADIUS


def ground_size(z, y) -> Column:
    """Width of a tile in metres at the latitude of its centre."""
    return F.cos(F.radians(tile_north(_c(y) + 0.5, z))) * WORLD / side(z)


def _laea() -> dict[str, float]:
    """Numbers of EPSG:3035: Lambert azimuthal equal area on GRS80, centre 10 E 52 N."""
    # GRS80 and the projection's origin.
    a, f = 6_378_137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    lat0 = math.radians(52)

    def q_number(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp = q_number(1.0)
    beta0 = math.asin(q_number(math.sin(lat0)) / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    return {"e": e, "e2": e2, "qp": qp, "sin": math.sin(beta0), "cos": math.cos(beta0), "rq": rq, "d": d, "lon": math.radians(10), "east": 4_321_000.0, "north": 3_210_000.0}


def laea_forward(lon, lat) -> tuple[Column, Column]:
    """Easting and northing in EPSG:3035."""
    k = _laea()
    s = F.sin(F.radians(_c(lat)))
    q = (1 - k["e2"]) * (s / (1 - k["e2"] * s * s) - F.log((1 - k["e"] * s) / (1 + k["e"] * s)) / (2 * k["e"]))
    beta = F.asin(q / k["qp"])
    turn = F.radians(_c(lon)) - k["lon"]
    b = k["rq"] * F.sqrt(2 / (1 + k["sin"] * F.sin(beta) + k["cos"] * F.cos(beta) * F.cos(turn)))
    return b * k["d"] * F.cos(beta) * F.sin(turn) + k["east"], b / k["d"] * (k["cos"] * F.sin(beta) - k["sin"] * F.cos(beta) * F.cos(turn)) + k["north"]


def laea_inverse(east, north) -> tuple[Column, Column]:
    """Longitude and latitude of a place in EPSG:3035, by the series of the authalic latitude."""
    k = _laea()
    e2 = k["e2"]
    x, y = _c(east) - k["east"], _c(north) - k["north"]
    rho = F.sqrt(x * x / k["d"] ** 2 + y * y * k["d"] ** 2)
    far = F.when(rho > 0, rho).otherwise(1.0)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * k["rq"])))
    beta = F.when(rho > 0, F.asin(F.cos(c) * k["sin"] + k["d"] * y * F.sin(c) * k["cos"] / far)).otherwise(math.asin(k["sin"]))
    lon = k["lon"] + F.atan2(x * F.sin(c), k["d"] * rho * k["cos"] * F.cos(c) - k["d"] ** 2 * y * k["sin"] * F.sin(c))
    lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
    return F.degrees(F.when(rho > 0, lon).otherwise(k["lon"])), F.degrees(lat)


# --- arithmetic on coordinates -------------------------------------------------------------------


def remap(z, x, y, flip_x: bool = False, flip_y: bool = False, swap_xy: bool = False) -> tuple[Column, Column]:
    """Mirrors, then exchanges the axes."""
    a = _long(side(z)) - 1 - _c(x) if flip_x else _c(x)
    b = _long(side(z)) - 1 - _c(y) if flip_y else _c(y)
    return (b, a) if swap_xy else (a, b)


def ancestor(value, steps) -> Column:
    """Coordinate of the tile so many levels up."""
    return _long(F.floor(_c(value) / F.pow(F.lit(2.0), _c(steps))))


def block_floor(value, size: int) -> Column:
    return _long(F.floor(_c(value) / F.lit(size))) * size


def block_ceil(value, size: int) -> Column:
    return block_floor(_c(value) + (size - 1), size)


def sort_index(z, x, y) -> Column:
    """Row-major rank over all levels."""
    return _long(F.floor((F.pow(F.lit(4.0), _c(z)) - 1) / 3)) + _long(side(z)) * _c(y) + _c(x)


def _bits(z) -> Column:
    return F.when(_c(z) > 0, F.sequence(_c(z).cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))


def _bit(value: Column, i: Column) -> Column:
    return F.call_function("shiftright", value, i).bitwiseAND(F.lit(1))


def morton(z, x, y) -> Column:
    """Interleaved bits within the level, x lowest."""
    step = lambda acc, i: acc * 4 + _bit(_long(_c(x)), i) + _bit(_long(_c(y)), i) * 2
    return F.aggregate(_bits(z), F.lit(0).cast("bigint"), lambda acc, i: _long(step(acc, i)))


def depth_first_key(z, x, y) -> Column:
    """Sorts a quadtree in post-order: the digits of the path, then a digit behind all others."""
    digits = F.transform(_bits(z), lambda i: (_bit(_long(_c(x)), i) + _bit(_long(_c(y)), i) * 2).cast("string"))
    return F.concat(F.array_join(digits, ""), F.lit("4"))


#: First Hilbert id of each level, the number of tiles of all levels above.
LEVEL_STARTS = [(4**z - 1) // 3 for z in range(32)]


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _constants(values: list[int]) -> Column:
    """Array of numbers, given as one text that Spark turns into a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _curve_tables() -> tuple[list[int], list[int]]:
    """Four levels of the curve at a time: by turn, four bits of x and four of y their four digits of the rank and the next turn, and
    by turn and digits the bits of x and y and the next turn. A turn exchanges the axes (bit 0) and mirrors both (bit 1)."""
    there, back = [0] * 1024, [0] * 1024
    for turn in range(4):
        for x in range(16):
            for y in range(16):
                now, digits = turn, 0
                for i in (3, 2, 1, 0):
                    right, low = ((v >> i & 1) ^ now >> 1 for v in ((y, x) if now & 1 else (x, y)))
                    digits = digits * 4 + (right * 3 ^ low)
                    if low == 0:
                        now ^= 1 | right << 1
                there[turn << 8 | x << 4 | y] = digits << 2 | now
                back[turn << 8 | digits] = x << 33 | y << 2 | now
    return there, back


_THERE, _BACK = _curve_tables()


def _along_curve(z: Column, table: list[int], width: int, key) -> Column:
    """The entries that a table gives from the level's coarsest bits on, put together, above the last turn. ``key`` picks the bits of a
    step; levels that are no multiple of four have zeros in front, each of which exchanges the axes."""
    entries = _constants(table)

    def step(acc: Column, i: Column) -> Column:
        at = F.shiftleft(acc.bitwiseAND(F.lit(3)), 8).bitwiseOR(key(i)).cast("int")
        return F.shiftleft(acc.bitwiseAND(F.lit(-4)), width).bitwiseOR(F.get(entries, at))

    places = F.sequence((z.cast("int") - 1).bitwiseAND(F.lit(-4)), F.lit(0), F.lit(-4))
    return F.when(z > 0, F.aggregate(places, _long(z).bitwiseAND(F.lit(1)), step)).otherwise(F.lit(0).cast("bigint"))


def _low_bits(value: Column, n: Column) -> Column:
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1)


def hilbert_id(z, x, y) -> Column:
    """Rank on the Hilbert curve of the level, behind all tiles of the levels above."""
    level = _c(z)

    def rank(both: Column) -> Column:
        bits = lambda i: F.call_function("shiftright", both, i + 28).bitwiseAND(F.lit(240)).bitwiseOR(F.call_function("shiftright", both, i).bitwiseAND(F.lit(15)))
        return F.shiftrightunsigned(_along_curve(level, _THERE, 8, bits), 2)

    both = F.shiftleft(_low_bits(_long(_c(x)), level), 32).bitwiseOR(_low_bits(_long(_c(y)), level))
    return F.when(level > 0, _let(both, rank)).otherwise(F.lit(0).cast("bigint")) + F.get(_constants(LEVEL_STARTS), level.cast("int"))


def hilbert_level(tile_id) -> Column:
    """Level of a Hilbert id: the last one that does not begin behind it."""
    # A level begins where 3 * id + 1 is a power of four.
    digits = lambda t: F.shiftright(F.length(F.bin(t * 3 + 1)) - 1, 1)
    return _let(_long(_c(tile_id)), lambda t: F.when(t >= LEVEL_STARTS[31], 31).when(t >= 0, digits(t)).otherwise(-1).cast("bigint"))


def hilbert_tile(tile_id) -> Column:
    """Struct (z, x, y) of a Hilbert id, the inverse of ``hilbert_id``. Negative ids give null."""

    def place(z: Column, rank: Column) -> Column:
        at = _along_curve(z, _BACK, 4, lambda i: F.call_function("shiftright", rank, i * 2).bitwiseAND(F.lit(255)))
        return _let(at, lambda p: F.struct(z.alias("z"), F.shiftrightunsigned(p, 33).alias("x"), F.shiftright(p, 2).bitwiseAND(F.lit((1 << 31) - 1)).alias("y")))

    def of(t: Column) -> Column:
        rank = lambda z: _low_bits(t - F.get(_constants(LEVEL_STARTS), z.cast("int")), z * 2)
        return F.when(t >= 0, _let(hilbert_level(t), lambda z: _let(rank(z), lambda r: place(z, r))))

    return _let(_long(_c(tile_id)), of)


def hilbert_ranges(level: int, box: tuple[int, int, int, int], most: int = 64) -> list[tuple[int, int]]:
    """Runs of Hilbert ids, both ends included, that hold a box (x_min, y_min, x_max, y_max) of a level: those of the
    quarters that lie in it, and where that makes more than ``most`` runs the nearest are joined, with ids of
    tiles outside between them."""
    x0, y0, x1, y1 = box
    runs: list[list[int]] = []

    def down(z: int, first: int, x: int, y: int, ux: tuple[int, int], uy: tuple[int, int]) -> None:
        """A square of the curve with its corner and the two directions in which it is run through."""
        n = 1 << level - z
        ends = [(x + a * (n - 1) * ux[0] + b * (n - 1) * uy[0], y + a * (n - 1) * ux[1] + b * (n - 1) * uy[1]) for a in (0, 1) for b in (0, 1)]
        left, right, top, low = min(e[0] for e in ends), max(e[0] for e in ends), min(e[1] for e in ends), max(e[1] for e in ends)
        if right < x0 or left > x1 or low < y0 or top > y1:
            return
        if left >= x0 and right <= x1 and top >= y0 and low <= y1 or z == level:
            if runs and runs[-1][1] == first - 1:
                runs[-1][1] = first + n * n - 1
            else:
                runs.append([first, first + n * n - 1])
            return
        h, q = n // 2, n * n // 4
        down(z + 1, first, x, y, uy, ux)
        down(z + 1, first + q, x + h * uy[0], y + h * uy[1], ux, uy)
        down(z + 1, first + 2 * q, x + h * (ux[0] + uy[0]), y + h * (ux[1] + uy[1]), ux, uy)
        down(z + 1, first + 3 * q, x + (2 * h - 1) * ux[0] + (h - 1) * uy[0], y + (2 * h - 1) * ux[1] + (h - 1) * uy[1], (-uy[0], -uy[1]), (-ux[0], -ux[1]))

    if x0 > x1 or y0 > y1:
        return []
    down(0, LEVEL_STARTS[level], 0, 0, (1, 0), (0, 1))
    gaps = sorted((b[0] - a[1], i) for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False)))
    joined = {i for _, i in gaps[: max(0, len(runs) - most)]}
    out: list[list[int]] = []
    for i, run in enumerate(runs):
        if i and i - 1 in joined:
            out[-1][1] = run[1]
        else:
            out.append(list(run))
    return [tuple(r) for r in out]


def in_hilbert_box(level: int, box: tuple[int, int, int, int], tile_id="id", most: int = 64) -> Column:
    """Predicate: the tile of a Hilbert id lies in a box of a level. The runs of ids reach a scan as plain comparisons, so that
    a table sorted by id is read only where the box is; tiles between runs are told apart by their coordinates."""
    runs = F.lit(False)
    for first, last in hilbert_ranges(level, box, most):
        runs = runs | _c(tile_id).between(first, last)
    return runs & _let(hilbert_tile(tile_id), lambda at: at["x"].between(box[0], box[2]) & at["y"].between(box[1], box[3]))


# --- bounding boxes ------------------------------------------------------------------------------


def bbox_to_range(bbox: tuple[float, float, float, float], level: int, border: int = 0) -> tuple[int, int, int, int]:
    """Tile range (x_min, y_min, x_max, y_max) of west, south, east, north; half-open at the east and south."""
    west, south, east, north = bbox
    if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError(f"bad bounding box {bbox}")
    n = 2**level

    def col(lon: float) -> int:
        return min(n - 1, max(0, math.floor(n * (lon / 360 + 0.5))))

    def row(lat: float) -> int:
        lat = min(89.999999, max(-89.999999, lat))
        return min(n - 1, max(0, math.floor(n * (0.5 - 0.5 * math.log(math.tan(lat * math.pi / 360 + math.pi / 4)) / math.pi))))

    x0, y0, x1, y1 = col(west + NUDGE), row(north - NUDGE), col(east - NUDGE), row(south + NUDGE)
    return max(0, x0 - border), max(0, y0 - border), min(n - 1, x1 + border), min(n - 1, y1 + border)


def in_bbox(bbox, levels: range, border: int = 0, z="z", x="x", y="y") -> Column:
    """Predicate: the tile lies in the box (and a ring of ``border`` tiles). One range for each level,
    so that it reaches a scan as plain comparisons; where x and y are computed from other columns, ``near_bbox``
    names them less often."""
    test = F.lit(False)
    for level in levels:
        x0, y0, x1, y1 = bbox_to_range(bbox, level, border)
        test = test | ((_c(z) == level) & _c(x).between(x0, x1) & _c(y).between(y0, y1))
    return test


def near_bbox(bbox, border: int = 0, z="z", x="x", y="y") -> Column:
    """As ``in_bbox`` for any level, with bounds that are computed from the level."""
    west, south, east, north = bbox
    bbox_to_range(bbox, 0)  # checks the box
    side = F.pow(F.lit(2.0), _c(z))
    share = lambda lat: 0.5 - 0.5 * math.log(math.tan(min(89.999999, max(-89.999999, lat)) * math.pi / 360 + math.pi / 4)) / math.pi
    cell = lambda part: F.greatest(F.lit(0.0), F.least(side - 1, F.floor(side * F.lit(part))))
    across = _c(x).between(cell((west + NUDGE) / 360 + 0.5) - border, cell((east - NUDGE) / 360 + 0.5) + border)
    return across & _c(y).between(cell(share(north - NUDGE)) - border, cell(share(south + NUDGE)) + border)


# --- tile boxes ----------------------------------------------------------------------------------
# A box is (x_min, y_min, x_max, y_max) of one level, both ends included; None is the empty box.

Box = tuple[int, int, int, int]


def box_union(a: Box | None, b: Box | None) -> Box | None:
    """The smallest box that holds both."""
    if a is None or b is None:
        return b if a is None else a
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def box_intersection(a: Box | None, b: Box | None) -> Box | None:
    if a is None or b is None:
        return None
    out = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return out if out[0] <= out[2] and out[1] <= out[3] else None


def box_grow(box: Box | None, size: int, level: int) -> Box | None:
    """With a ring of ``size`` tiles, within the level."""
    last = (1 << level) - 1
    return box and (max(0, box[0] - size), max(0, box[1] - size), min(last, box[2] + size), min(last, box[3] + size))


def box_shift(box: Box | None, dx: int, dy: int, level: int) -> Box | None:
    """Moved; what leaves the level is cut off."""
    last = (1 << level) - 1
    return box and box_intersection((box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy), (0, 0, last, last))


def box_at_level(box: Box | None, level: int, to: int) -> Box | None:
    """The same area on another level, or the tiles that hold it."""
    if box is None or to == level:
        return box
    if to > level:
        steps = to - level
        return box[0] << steps, box[1] << steps, (box[2] + 1 << steps) - 1, (box[3] + 1 << steps) - 1
    return tuple(v >> level - to for v in box)


def box_remapped(box: Box | None, level: int, flip_x: bool = False, flip_y: bool = False, swap_xy: bool = False) -> Box | None:
    """As ``remap`` moves each tile of it."""
    if box is None:
        return None
    last = (1 << level) - 1
    x0, y0, x1, y1 = box
    if flip_x:
        x0, x1 = last - x1, last - x0
    if flip_y:
        y0, y1 = last - y1, last - y0
    return (y0, x0, y1, x1) if swap_xy else (x0, y0, x1, y1)


def box_index(box: Box, x="x", y="y") -> Column:
    """Row-major place of a tile in the box; null outside."""
    inside = _c(x).between(box[0], box[2]) & _c(y).between(box[1], box[3])
    return F.when(inside, (_c(y) - box[1]) * (box[2] - box[0] + 1) + _c(x) - box[0]).cast("bigint")


def box_tile(box: Box, index="index") -> tuple[Column, Column]:
    """(x, y) of a row-major place: inverse of ``box_index``."""
    width = box[2] - box[0] + 1
    return (F.pmod(_c(index), F.lit(width)) + box[0]).cast("bigint"), (F.floor(_c(index) / width) + box[1]).cast("bigint")
