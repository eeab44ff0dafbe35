"""Map coordinates to WGS84 with closed formulas, metre accuracy for map pins."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients (power of dx, power of dy, value) of the published Dutch grid approximation
_RD_LAT = ((0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.24750), (2, 1, -0.84978), (0, 3, -0.06550),
           (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.00530), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012))
_RD_LON = ((1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594),
           (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, 0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 1, -0.00022),
           (5, 0, 0.00026))


def _times(base: Column, n: int) -> Column:
    out = base
    for _ in range(n - 1):
        out = out * base
    return out


def _polynomial(terms, dx: Column, dy: Column) -> Column:
    total = F.lit(0.0)
    for i, j, value in terms:
        part = F.lit(value)
        if i:
            part = part * _times(dx, i)
        if j:
            part = part * _times(dy, j)
        total = total + part
    return total


def rd_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Dutch grid (EPSG:28992) to latitude and longitude."""
    dx, dy = (x - 155000.0) * 1e-5, (y - 463000.0) * 1e-5
    return (F.lit(52.15517440) + _polynomial(_RD_LAT, dx, dy) / 3600.0,
            F.lit(5.38720621) + _polynomial(_RD_LON, dx, dy) / 3600.0)


def utm_to_wgs84(easting: Column, northing: Column, central_meridian: float = 9.0) -> tuple[Column, Column]:
    """Northern UTM zone to latitude and longitude by the inverse series on the WGS84 ellipsoid."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    n = f / (2 - f)
    mu = northing / (k0 * a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256))
    foot = mu
    for k, amp in ((2, 3 * n / 2 - 27 * n ** 3 / 32), (4, 21 * n ** 2 / 16 - 55 * n ** 4 / 32), (6, 151 * n ** 3 / 96)):
        foot = foot + F.lit(amp) * F.sin(mu * k)
    s2 = F.sin(foot) * F.sin(foot)
    t = F.tan(foot) * F.tan(foot)
    c = F.lit(ep2) * F.cos(foot) * F.cos(foot)
    nu = F.lit(a) / F.sqrt(1 - e2 * s2)
    rho = F.lit(a * (1 - e2)) / F.pow(1 - e2 * s2, F.lit(1.5))
    d = (easting - 500000.0) / (nu * k0)
    d2 = d * d
    lat_series = d2 * (F.lit(0.5) - d2 / 24.0 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2)
                       + d2 * d2 / 720.0 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c))
    lon_series = d * (1 - d2 / 6.0 * (1 + 2 * t + c)
                      + d2 * d2 / 120.0 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t))
    lat = foot - nu * F.tan(foot) / rho * lat_series
    return F.degrees(lat), F.degrees(lon_series / F.cos(foot)) + central_meridian


