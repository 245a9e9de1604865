"""Observatory sites and arrival times at the solar system's barycentre, on numpy.

No ephemeris file is needed: the Earth, the Sun's motion about the barycentre and the
Earth's turning come from mean orbital elements, good to about 0.1 s of arrival time.
A converter with an ephemeris can be passed wherever `barycentric` is used.
"""

from __future__ import annotations

import math

import numpy as np

# Geocentric coordinates in metres, or longitude, latitude (degrees east, north) and height (metres).
SITES_XYZ = {
    "tianma65": (-2826708.6476, 4679237.0665, 3274667.5514),
    "torun": (3638558.5100, 1221969.7200, 5077036.7600),
    "onsala85": (3370965.8787, 711466.1978, 5349664.2006),
    "westerbork_rt1": (3828767.2647, 442446.1739, 5064921.5700),
}
SITES_GEODETIC = {"stockert": (6.7233, 50.5700, 435.0), "effelsberg": (6.8828, 50.5247, 369.0)}

# Mean elements at J2000 and their change a century: a (au), e, I, L, long. of perihelion, long. of node (degrees).
ELEMENTS = {
    "earth": ((1.00000261, 0.01671123, -0.00001531, 100.46457166, 102.93768193, 0.0), (0.00000562, -0.00004392, -0.01294668, 35999.37244981, 0.32327364, 0.0)),
    "jupiter": ((5.20288700, 0.04838624, 1.30439695, 34.39644051, 14.72847983, 100.47390909), (-0.00011607, -0.00013253, -0.00183714, 3034.74612775, 0.21252668, 0.20469106)),
    "saturn": ((9.53667594, 0.05386179, 2.48599187, 49.95424423, 92.59887831, 113.66242448), (-0.00125060, -0.00050991, 0.00193609, 1222.49362201, -0.41897216, -0.28867794)),
    "uranus": ((19.18916464, 0.04725744, 0.77263783, 313.23810451, 170.95427630, 74.01692503), (-0.00196176, -0.00004397, -0.00242939, 428.48202785, 0.40805281, 0.04240589)),
    "neptune": ((30.06992276, 0.00859048, 1.77004347, -55.12002969, 44.96476227, 131.78422574), (0.00026291, 0.00005105, 0.00035372, 218.45945325, -0.32241464, -0.00508664)),
}
SUN_OVER = {"jupiter": 1047.3486, "saturn": 3497.898, "uranus": 22902.98, "neptune": 19412.24}
AU_SECONDS = 499.004783836
LIGHT = 299_792_458.0
OBLIQUITY = math.radians(23.43928)
TT_MINUS_UTC = 69.184  # since 2017


def site_xyz(name: str) -> tuple[float, float, float]:
    """Geocentric coordinates in metres; names in any case, the coordinate table before the geodetic one."""
    key = name.lower()
    if key in SITES_XYZ:
        return SITES_XYZ[key]
    if key not in SITES_GEODETIC:
        raise KeyError(f"no site {name!r}")
    lon, lat, height = SITES_GEODETIC[key]
    lon, lat = math.radians(lon), math.radians(lat)
    flat = 1 / 298.257223563
    e2 = flat * (2 - flat)
    n = 6_378_137.0 / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    return ((n + height) * math.cos(lat) * math.cos(lon), (n + height) * math.cos(lat) * math.sin(lon), (n * (1 - e2) + height) * math.sin(lat))


def heliocentric(body: str, mjd: np.ndarray) -> np.ndarray:
    """Equatorial position in au at a time in TT days."""
    century = (mjd - 51544.5) / 36525
    a, e, incl, mean, peri, node = (p + r * century for p, r in zip(*ELEMENTS[body], strict=True))
    incl, mean, peri, node = map(np.radians, (incl, mean, peri, node))
    anomaly = np.mod(mean - peri + np.pi, 2 * np.pi) - np.pi
    ecc = anomaly + e * np.sin(anomaly)
    for _ in range(8):
        ecc = ecc - (ecc - e * np.sin(ecc) - anomaly) / (1 - e * np.cos(ecc))
    x, y = a * (np.cos(ecc) - e), a * np.sqrt(1 - e**2) * np.sin(ecc)
    w = peri - node
    px = (np.cos(w) * np.cos(node) - np.sin(w) * np.sin(node) * np.cos(incl)) * x + (-np.sin(w) * np.cos(node) - np.cos(w) * np.sin(node) * np.cos(incl)) * y
    py = (np.cos(w) * np.sin(node) + np.sin(w) * np.cos(node) * np.cos(incl)) * x + (-np.sin(w) * np.sin(node) + np.cos(w) * np.cos(node) * np.cos(incl)) * y
    pz = np.sin(w) * np.sin(incl) * x + np.cos(w) * np.sin(incl) * y
    return np.stack([px, py * math.cos(OBLIQUITY) - pz * math.sin(OBLIQUITY), py * math.sin(OBLIQUITY) + pz * math.cos(OBLIQUITY)])


def require_conversion(found: np.ndarray, recorded: np.ndarray, tolerance: float = 1e-8) -> None:
    """Fails if a converter's times (days) differ from recorded ones by the tolerance or more: the gate before a study.

    `barycentric` is good to 0.1 s and does not pass at the default; a converter with an ephemeris has to.
    """
    found, recorded = np.asarray(found, float), np.asarray(recorded, float)
    if found.shape != recorded.shape or not np.all(np.abs(found - recorded) < tolerance):
        raise ValueError(f"converted times differ from the recorded ones by {tolerance} d or more")


def barycentric(mjd_utc: np.ndarray, site: str, ra_deg: float, dec_deg: float) -> np.ndarray:
    """Topocentric UTC days as barycentric TDB days at infinite frequency."""
    utc = np.asarray(mjd_utc, dtype=float)
    tt = utc + TT_MINUS_UTC / 86400
    sun = np.zeros((3, *utc.shape))
    for body, ratio in SUN_OVER.items():
        sun -= heliocentric(body, tt) / (1 + ratio)
    # the elements are of the Earth-Moon barycentre; the Earth lies 4,670 km from it, away from the Moon
    days = tt - 51544.5
    moon_lon = np.radians(218.316 + 13.176396 * days) + np.radians(6.289) * np.sin(np.radians(134.963 + 13.064993 * days))
    moon_lat = np.radians(5.128) * np.sin(np.radians(93.272 + 13.229350 * days))
    mx, my, mz = np.cos(moon_lat) * np.cos(moon_lon), np.cos(moon_lat) * np.sin(moon_lon), np.sin(moon_lat)
    moon = np.stack([mx, my * math.cos(OBLIQUITY) - mz * math.sin(OBLIQUITY), my * math.sin(OBLIQUITY) + mz * math.cos(OBLIQUITY)]) * 4670e3 / LIGHT
    x, y, z = site_xyz(site)
    turn = np.radians(280.46061837 + 360.98564736629 * (utc - 51544.5))
    place = np.stack([x * np.cos(turn) - y * np.sin(turn), x * np.sin(turn) + y * np.cos(turn), np.full(utc.shape, z)]) / LIGHT
    ra, dec = math.radians(ra_deg), math.radians(dec_deg)
    towards = np.asarray([math.cos(dec) * math.cos(ra), math.cos(dec) * math.sin(ra), math.sin(dec)])
    delay = np.tensordot(towards, (heliocentric("earth", tt) + sun) * AU_SECONDS - moon + place, axes=1)
    mean = np.radians(357.53 + 0.98560028 * days)
    tdb = 0.001657 * np.sin(mean) + 0.000022 * np.sin(2 * mean)
    return tt + (delay + tdb) / 86400
