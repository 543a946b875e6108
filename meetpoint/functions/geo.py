"""Geographic Column expressions: hexagonal cell keys, distances, place texts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public H3 geometry: face centre latitude and longitude, azimuth of the first axis.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
ODD_TURN = 0.333473172251832115336
SCALE = 0.38196601125010500003
#: (2 a + b) / 3 of the WGS 84 ellipsoid, in metres.
EARTH_RADIUS = 6371008.771415059


def plane(face: int, latitude: float, longitude: float) -> tuple[float, float]:
    """Where a point (in radians) lies in a face's plane at resolution 0; the inner circle has radius 1, a corner is at (2, 0)."""
    fa, fo, face_az = FACES[face]
    az = math.atan2(math.cos(latitude) * math.sin(longitude - fo), math.cos(fa) * math.sin(latitude) - math.sin(fa) * math.cos(latitude) * math.cos(longitude - fo))
    cosine = math.sin(fa) * math.sin(latitude) + math.cos(fa) * math.cos(latitude) * math.cos(longitude - fo)
    r = math.tan(math.acos(cosine)) / SCALE
    return r * math.cos(face_az - az), r * math.sin(face_az - az)


def across(face: int, edge: int) -> tuple[int, int]:
    """(face on the other side of an edge, turn of its plane against this one in sixths of a circle).

    Edges 0, 1 and 2 have their middles at 60, 180 and 300 degrees of the face's plane.
    """
    la, lo = (math.radians(x) for x in _on_sphere(face, math.cos(math.pi / 3 * (2 * edge + 1)), math.sin(math.pi / 3 * (2 * edge + 1)), 0))

    def distance(g: int) -> float:
        fa, fo, _ = FACES[g]
        return -(math.sin(fa) * math.sin(la) + math.cos(fa) * math.cos(la) * math.cos(lo - fo))

    other = min((g for g in range(len(FACES)) if g != face), key=distance)
    x, y = plane(other, la, lo)
    # Seen from the other centre, the edge's middle lies opposite to how it lies from this one.
    return other, round((math.atan2(y, x) - math.pi / 3 * (2 * edge + 1) - math.pi) / (math.pi / 3)) % 6


@cache
def edges(res: int) -> list[list[tuple[int, int, int, int]]]:
    """For each face its three edges: the face across, the centre of that in this face's lattice (a, b), and the turn."""
    a, b = (0, 2) if res % 2 == 0 else (1, 2)
    scale = 7 ** (res // 2) * (1 if res % 2 == 0 else 2)
    faces = []
    for face in range(len(FACES)):
        found = []
        for edge in range(3):
            other, turn = across(face, edge)
            na, nb = a, b
            for _ in range(2 * edge):  # by 120 degrees
                na, nb = -nb, na + nb
            found.append((other, na * scale, nb * scale, turn))
        faces.append(found)
    return faces


def cell_key(latitude: Column, longitude: Column, res: int) -> Column:
    """Struct (face, a, b) of the hexagon that holds the point; null for null or non-finite input.

    The point is rounded in the plane of its own face of the icosahedron; where the
    hexagon's centre lies beyond an edge, the lattice is carried on across it, so
    the key is that of the centre's face, and of the face with the smaller number if
    it lies on the edge.  Equal keys mean equal cells but at the twelve corners,
    whose cells are pentagons.
    """
    return _keys(res)(latitude.cast("double"), longitude.cast("double"))


@cache
def _keys(res: int) -> Callable[[Column, Column], Column]:
    """The keys of whole batches in numpy: Spark interprets its own functions on arrays row by row, at some 30 times the cost."""
    face_la, face_lo, face_az = np.array(FACES).T
    centres = np.stack([np.cos(face_lo) * np.cos(face_la), np.sin(face_lo) * np.cos(face_la), np.sin(face_la)])
    edge = np.array(edges(res), np.int64)
    odd, scale, third, most = ODD_TURN if res % 2 else 0.0, math.sqrt(7) ** res / SCALE, math.sqrt(3) / 2, 4 * 7**res
    kind = pa.struct([("face", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def keys(latitude: pa.Array, longitude: pa.Array) -> pa.Array:
        lat, lon = (np.asarray(pc.fill_null(c, math.nan)) for c in (latitude, longitude))
        good = (np.abs(lat) <= 90) & (np.abs(lon) <= 360)  # NaN is neither
        la, lo = np.radians(np.where(good, lat, 0.0)), np.radians(np.where(good, lon, 0.0))
        point = (np.cos(lo) * np.cos(la), np.sin(lo) * np.cos(la), np.sin(la))
        distance = sum((p[:, None] - c) ** 2 for p, c in zip(point, centres, strict=True))
        face = distance.argmin(axis=1)
        d, fa, fo, az = distance[np.arange(len(face)), face], face_la[face], face_lo[face], face_az[face]
        theta = az - np.arctan2(np.cos(la) * np.sin(lo - fo), np.cos(fa) * np.sin(la) - np.sin(fa) * np.cos(la) * np.cos(lo - fo)) - odd
        r = np.tan(np.arccos(1 - d / 2)) * scale
        fb = r * np.sin(theta) / third
        fa = r * np.cos(theta) - fb / 2
        fc = -fa - fb
        ra, rb, rc = np.rint(fa), np.rint(fb), np.rint(fc)
        da, db, dc = np.abs(ra - fa), np.abs(rb - fb), np.abs(rc - fc)
        first = (da > db) & (da > dc)
        a = np.where(first, -rb - rc, ra).astype(np.int64)
        b = np.where(~first & (db > dc), -ra - rc, rb).astype(np.int64)
        # Twice the product with the vector to the centre across, less where that is on the edge.
        to, na, nb, turn = edge[face].transpose(2, 0, 1)
        over = 2 * a[:, None] * na + 2 * b[:, None] * nb + a[:, None] * nb + b[:, None] * na - most
        at = np.lexsort((to, over))[:, -1]
        rows = np.arange(len(face))
        over, to, na, nb, turn = (x[rows, at] for x in (over, to, na, nb, turn))
        beyond = (over > 0) | ((over == 0) & (to < face))
        ca, cb = a - na, b - nb
        moved = np.stack([(ca, cb), (-cb, ca + cb), (-ca - cb, ca), (-ca, -cb), (cb, -ca - cb), (ca + cb, -ca)])
        columns = np.where(beyond, to, face).astype(np.int32), np.where(beyond, moved[turn, 0, rows], a), np.where(beyond, moved[turn, 1, rows], b)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind), mask=pa.array(~good))

    return F.arrow_udf(keys, "face int, a long, b long")


def _on_sphere(face: int, x: float, y: float, res: int) -> tuple[float, float]:
    fa, fo, face_az = FACES[face]
    th = math.atan2(y, x)
    r = math.atan(math.hypot(x, y) * SCALE / math.sqrt(7) ** res)
    az = face_az - th - (ODD_TURN if res % 2 else 0.0)
    la = math.asin(math.sin(fa) * math.cos(r) + math.cos(fa) * math.sin(r) * math.cos(az))
    lo = fo + math.atan2(math.sin(az) * math.sin(r) * math.cos(fa), math.cos(r) - math.sin(fa) * math.sin(la))
    return math.degrees(la), math.degrees(lo)


def cell_centre(face: int, a: int, b: int, res: int) -> tuple[float, float]:
    """Latitude and longitude in degrees of a cell's centre (for making grids)."""
    return _on_sphere(face, a + b / 2, b * math.sqrt(3) / 2, res)


def distance_meters(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance by the haversine formula."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def to_position(latitude: Column, longitude: Column) -> Column:
    """Struct of both coordinates; null unless both are there."""
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def street_line(street: Column, housenumber: Column) -> Column:
    return F.concat_ws(" ", _full(street), _full(housenumber))


def place_label(name: Column, street: Column, housenumber: Column) -> Column:
    """`name, street number` for a named place whose name is not its street; else the name, else the street line."""
    line = street_line(street, housenumber)
    qualified = (_full(name).isNotNull()) & (line != "") & ~name.eqNullSafe(street)
    return F.when(qualified, F.concat_ws(", ", name, line)).otherwise(F.coalesce(name, line))


def place_context(postcode: Column, city: Column, district: Column, state: Column, country: Column) -> Column:
    """`postcode city, state, country` without blanks; the district stands in for a null city only."""
    locality = F.concat_ws(" ", _full(postcode), _full(F.coalesce(city, district)))
    return F.concat_ws(", ", _full(locality), _full(state), _full(country))
