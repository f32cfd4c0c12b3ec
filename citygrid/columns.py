"""Column expressions in SQL that operators share: the transverse Mercator projection."""

from __future__ import annotations

import math

# fixed values: WGS84 and UTM
AXIS, FLATTENING, SCALE, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)


def series(*rows: dict[int, float]) -> list[float]:
    """Sums of coefficient * N**power."""
    return [sum(c * N**k for k, c in row.items()) for row in rows]


# fixed values: six terms of Krueger's series, forward and inverse
FORWARD = series(
    {1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180, 5: -127 / 288, 6: 7891 / 37800}, {2: 13 / 48, 3: -3 / 5, 4: 557 / 1440, 5: 281 / 630, 6: -1983433 / 1935360},
    {3: 61 / 240, 4: -103 / 140, 5: 15061 / 26880, 6: 167603 / 181440}, {4: 49561 / 161280, 5: -179 / 168, 6: 6601661 / 7257600}, {5: 34729 / 80640, 6: -3418889 / 1995840}, {6: 212378941 / 319334400},
)
INVERSE = series(
    {1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360, 5: -81 / 512, 6: 96199 / 604800}, {2: 1 / 48, 3: 1 / 15, 4: -437 / 1440, 5: 46 / 105, 6: -1118711 / 3870720},
    {3: 17 / 480, 4: -37 / 840, 5: -209 / 4480, 6: 5569 / 90720}, {4: 4397 / 161280, 5: -11 / 504, 6: -830251 / 7257600}, {5: 4583 / 161280, 6: -108847 / 3991680}, {6: 20648693 / 638668800},
)


def zone(lon: str) -> str:
    return f"CAST(pmod(floor(({lon} + 180) / 6), 60) + 1 AS INT)"


def meridian(zone: str) -> str:
    """The central meridian of a UTM zone, in radians."""
    return f"radians(6 * {zone} - 183)"


def _terms(coefficients: list[float], a: str, b: str, f: str, g: str) -> str:
    return " + ".join(f"({c!r}) * {f}({2 * k} * {a}) * {g}({2 * k} * {b})" for k, c in enumerate(coefficients, 1)).replace("e-", "E-")


def forward(points: str, middle: str) -> str:
    """An array of (lat, lon) in degrees -> an array of (x, y) in metres of the zone with
    central meridian ``middle``; without the false northing of the south."""
    sphere = f"transform({points}, p -> named_struct('l', radians(p.lon) - {middle}, 't', sinh(atanh(sin(radians(p.lat))) - {ECC!r} * atanh({ECC!r} * sin(radians(p.lat))))))"
    plane = f"transform({sphere}, p -> named_struct('u', atan2(p.t, cos(p.l)), 'v', asinh(sin(p.l) / sqrt(p.t * p.t + cos(p.l) * cos(p.l)))))"
    x, y = f"p.v + {_terms(FORWARD, 'p.u', 'p.v', 'cos', 'sinh')}", f"p.u + {_terms(FORWARD, 'p.u', 'p.v', 'sin', 'cosh')}"
    return f"transform({plane}, p -> named_struct('x', {FALSE_EAST} + {SCALE * RADIUS!r} * ({x}), 'y', {SCALE * RADIUS!r} * ({y})))"


def wrapped(lon: str) -> str:
    return f"(pmod({lon} + 180, 360e0) - 180)"


def inverse(points: str, middle: str) -> str:
    """The way back: (x, y) -> (lat, lon) in degrees. Longitudes go on beyond 180 on either side of
    the central meridian, so that least and most of them make sense; see ``wrapped``."""
    plane = f"transform({points}, p -> named_struct('u', p.y / {SCALE * RADIUS!r}, 'v', (p.x - {FALSE_EAST}) / {SCALE * RADIUS!r}))"
    sphere = f"transform({plane}, p -> named_struct('u', p.u - ({_terms(INVERSE, 'p.u', 'p.v', 'sin', 'cosh')}), 'v', p.v - ({_terms(INVERSE, 'p.u', 'p.v', 'cos', 'sinh')})))"
    level = f"transform({sphere}, p -> named_struct('s', sin(p.u) / cosh(p.v), 'l', {middle} + atan2(sinh(p.v), cos(p.u))))"
    # the sine of the latitude, from that of the conformal latitude; each step gains more than two digits
    lat = f"aggregate(sequence(1, 7), p.s, (s, k) -> tanh(atanh(p.s) + {ECC!r} * atanh({ECC!r} * s)))"
    return f"transform({level}, p -> named_struct('lat', degrees(asin({lat})), 'lon', degrees(p.l)))"
