"""Distances and bearings on the WGS 84 ellipsoid as Column formulas, in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half axes and flattening of WGS 84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
#: Rounds of the iteration at most, and the change of the longitude (radians) at which it has come to rest.
ROUNDS, REST = 60, 1e-13


def _reduced(lat: Column) -> Column:
    return F.atan((1 - FLAT) * F.tan(F.radians(lat)))


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(metres, azimuth): length and bearing at the first point (degrees, clockwise from north) of the shortest line.

    The longitude on the auxiliary sphere is iterated until it moves by less than REST (about a micrometre), which takes
    three or four rounds but for nearly antipodal points. Where it doesn't come to rest within ROUNDS, or leaves the half circle,
    which happens only within about half a degree of the antipode, both are null. Equal points are 0 metres apart, at
    azimuth 0. A null or a latitude beyond a pole gives nulls.
    """
    half = F.pi()
    apart = F.radians(lon2 - lon1)
    span = F.pmod(apart + half, 2 * half) - half  # between half a circle to the west and to the east
    u1, u2 = _reduced(lat1), _reduced(lat2)
    start = F.struct(
        span.alias("span"), F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), span.alias("x"), F.lit(2.0).alias("moved"),
        *[F.lit(0.0).alias(n) for n in ("sin_arc", "cos_arc", "arc", "cos2_tilt", "middle")],
    )

    def step(s: Column, _: Column) -> Column:
        def body(v: Column) -> Column:
            east, north = s["c2"] * v["sin"], s["c1"] * s["s2"] - s["s1"] * s["c2"] * v["cos"]
            sin_arc = F.sqrt(east * east + north * north)
            cos_arc = s["s1"] * s["s2"] + s["c1"] * s["c2"] * v["cos"]
            return _let(F.struct(sin_arc.alias("sin_arc"), cos_arc.alias("cos_arc"), F.atan2(sin_arc, cos_arc).alias("arc"), F.coalesce(F.try_divide(s["c1"] * s["c2"] * v["sin"], sin_arc), F.lit(0.0)).alias("tilt")), tilted)

        def tilted(t: Column) -> Column:
            cos2 = 1 - t["tilt"] * t["tilt"]
            middle = F.coalesce(t["cos_arc"] - F.try_divide(2 * s["s1"] * s["s2"], cos2), F.lit(0.0))  # on the equator: 0
            c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
            x = s["span"] + (1 - c) * FLAT * t["tilt"] * (t["arc"] + c * t["sin_arc"] * (middle + c * t["cos_arc"] * (2 * middle * middle - 1)))
            return F.struct(*[s[n].alias(n) for n in ("span", "s1", "c1", "s2", "c2")], x.alias("x"), F.abs(x - s["x"]).alias("moved"), *[t[n].alias(n) for n in ("sin_arc", "cos_arc", "arc")], cos2.alias("cos2_tilt"), middle.alias("middle"))

        moving = _let(F.struct(F.sin(s["x"]).alias("sin"), F.cos(s["x"]).alias("cos")), body)
        return F.when((s["moved"] < REST) | (F.abs(s["x"]) > half), s).otherwise(moving)

    def finish(s: Column) -> Column:
        sq = s["cos2_tilt"] * ((A * A - B * B) / (B * B))
        p = 1 + sq / 16384 * (4096 + sq * (-768 + sq * (320 - 175 * sq)))
        q = sq / 1024 * (256 + sq * (-128 + sq * (74 - 47 * sq)))
        m = s["middle"]
        less = q * s["sin_arc"] * (m + q / 4 * (s["cos_arc"] * (2 * m * m - 1) - q / 6 * m * (4 * s["sin_arc"] * s["sin_arc"] - 3) * (4 * m * m - 3)))
        bearing = F.degrees(F.atan2(s["c2"] * F.sin(s["x"]), s["c1"] * s["s2"] - s["s1"] * s["c2"] * F.cos(s["x"])))
        settled = (s["moved"] < REST) & (F.abs(s["x"]) <= half)
        return F.struct(F.when(settled, B * p * (s["arc"] - less)).alias("metres"), F.when(settled, F.pmod(bearing + 360, F.lit(360.0))).alias("azimuth"))

    known = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.isNotNull() & lon2.isNotNull()
    nothing = F.struct(F.lit(None).cast("double").alias("metres"), F.lit(None).cast("double").alias("azimuth"))
    same = F.struct(F.lit(0.0).alias("metres"), F.lit(0.0).alias("azimuth"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)
    return F.when(known & (lat1 == lat2) & (span == 0), same).when(known, ends).otherwise(nothing)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def project(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """struct(x, y): azimuthal equidistant metres around (lat0, lon0): the geodesic's length in the direction in which it leaves."""
    return _let(
        geodesic(F.lit(float(lat0)), F.lit(float(lon0)), lat, lon),
        lambda g: F.struct((g["metres"] * F.sin(F.radians(g["azimuth"]))).alias("x"), (g["metres"] * F.cos(F.radians(g["azimuth"]))).alias("y")),
    )


def geodesic_sql(source: str, lat1: str, lon1: str, lat2: str, lon2: str, keep: str, rounds: int = 8) -> str:
    """CTEs that end with `geodesics` (keep, metres, azimuth) for the rows of `source`, for points that are far from antipodal and differ; a round per CTE."""
    f, ctes = repr(FLAT) + "e0", []
    ctes.append(f"geo0 as (select {keep}, radians({lon2} - {lon1}) as span, atan({1 - FLAT!r}e0 * tan(radians({lat1}))) as u1, atan({1 - FLAT!r}e0 * tan(radians({lat2}))) as u2, radians({lon2} - {lon1}) as x from {source})")
    for i in range(1, rounds + 1):
        ctes.append(f"""geo{i} as (
  select {keep}, span, u1, u2, span + (1 - c) * {f} * tilt * (arc + c * sin_arc * (middle + c * cos_arc * (2 * middle * middle - 1))) as x, sin_arc, cos_arc, arc, cos2, middle
  from (select *, {f} / 16 * cos2 * (4 + {f} * (4 - 3 * cos2)) as c, coalesce(cos_arc - 2 * sin(u1) * sin(u2) / nullif(cos2, 0), 0) as middle
  from (select *, atan2(sin_arc, cos_arc) as arc, 1 - tilt * tilt as cos2
  from (select *, coalesce(cos(u1) * cos(u2) * sin(x) / nullif(sin_arc, 0), 0) as tilt
  from (select *, sqrt(pow(cos(u2) * sin(x), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x), 2)) as sin_arc, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(x) as cos_arc from (select {keep}, span, u1, u2, x from geo{i - 1}))))))""")
    ratio = repr((A * A - B * B) / (B * B)) + "e0"
    ctes.append(f"""geodesics as (
  select {keep}, {B!r}e0 * (1 + sq / 16384 * (4096 + sq * (-768 + sq * (320 - 175 * sq)))) * (arc - q * sin_arc * (middle + q / 4 * (cos_arc * (2 * middle * middle - 1) - q / 6 * middle * (4 * sin_arc * sin_arc - 3) * (4 * middle * middle - 3)))) as metres,
         fmod(degrees(atan2(cos(u2) * sin(x), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(x))) + 360e0, 360e0) as azimuth
  from (select *, sq / 1024 * (256 + sq * (-128 + sq * (74 - 47 * sq))) as q from (select *, cos2 * {ratio} as sq from geo{rounds})))""")
    return ",\n".join(ctes)
