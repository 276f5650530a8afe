"""Emission bands and their spectral lines."""

from pyspark.sql import functions as F

# One line per row, as band, nm, configuration, J low-high, term,
# transition rate 1/s, lower energy eV, upper energy eV.
LINES = [
    ("CIV-444", 444.034, "1s2.5p-1s2.6d", "1/2-3/2", None, 8.72e7, 55.650849, 58.442404),
    ("CIV-444", 444.150, "1s2.5p-1s2.6d", "3/2-5/2", None, 1.05e8, 55.651717, 58.442553),
    ("CIV-444", 444.174, "1s2.5p-1s2.6d", "3/2-3/2", None, 1.74e7, 55.651717, 58.44244),
    ("CIV-465", 465.751, "1s2.5f-1s2.6g", "*-*", None, 2.83e8, 55.785632, 58.446892),
    ("CIV-465", 465.846, "1s2.5g-1s2.6h", "*-*", None, 4.21e8, 55.786116, 58.447016),
    ("CIV-547", 547.00, "1s2.7f-1s2.10g", "*-*", None, 1.82e7, 60.050765, 62.31675),
    ("CIV-547", 547.11, "1s2.7h-1s2.10i", "*-*", None, 1.86e7, 60.051248, 62.316788),
    ("CIV-547", 547.11, "1s2.7g-1s2.10h", "*-*", None, 2.02e7, 60.051224, 62.316775),
    ("CIV-547", 547.11, "1s2.7i-1s2.10k", "*-*", None, 1.16e7, 60.051273, 62.316788),
    ("CIV-547", 547.12, "1s2.7i-1s2.10h", "*-*", None, 5.52e4, 60.051273, 62.316775),
    ("CIV-547", 547.12, "1s2.7h-1s2.10g", "*-*", None, 2.42e5, 60.051248, 62.31675),
    ("CIV-547", 547.14, "1s2.7g-1s2.10f", "*-*", None, 6.73e5, 60.051224, 62.316651),
    ("CIV-580", 580.131, "1s2.3s-1s2.3p", "1/2-3/2", None, 3.17e7, 37.548356, 39.684927),
    ("CIV-706", 706.42, "1s2.7g-1s2.9h", "*-*", None, 3.18e7, 60.051224, 61.80632),
    ("CIV-706", 706.43, "1s2.7h-1s2.9i", "*-*", None, 3.37e7, 60.051248, 61.80632),
    ("CIV-706", 706.44, "1s2.7i-1s2.9h", "*-*", None, 1.16e5, 60.051273, 61.80632),
    ("CIV-706", 706.5, "1s2.7i-1s2.9k", "*-*", None, 2.69e7, 60.051273, 61.806183),
    ("CIV-706", 706.51, "1s2.7h-1s2.9g", "*-*", None, 4.46e5, 60.051248, 61.806121),
    ("CIV-706", 706.55, "1s2.7g-1s2.9f", "*-*", None, 1.13e6, 60.051224, 61.805997),
    ("CIV-706", 706.87, "1s2.7f-1s2.9d", "*-*", None, 2.41e6, 60.050765, 61.804758),
    ("CIV-772", 772.430, "1s2.6f-1s2.7g", "*-*", None, 9.64e7, 58.446471, 60.051224),
    ("CIV-772", 772.591, "1s2.6g-1s2.7h", "*-*", None, 1.36e8, 58.446892, 60.051248),
    ("CIV-772", 772.621, "1s2.6h-1s2.7i", "*-*", None, 1.90e8, 58.447016, 60.051273),
    ("CII-515", 515.1085, "2s2p3s-2s2p3p", "5/2-3/2", None, 4.16e7, 20.709788, 23.116071),
    ("CIII-464", 464.7418, "1s2.2s3s-1s2.2s3p", "1-2", None, 7.26e7, 29.534648, 32.201709),
    ("Xe-461", 461.18882, "5p4.6s-5p2.7p", "2-1", None, 1e6, 8.315316, 11.0029229),
    ("Xe-462", 462.42756, "5p4.6s-5p2.7p", "2-2", None, 7.2e5, 8.3153160, 10.9687844),
    ("Xe-467", 467.12258, "5p4.6s-5p2.7p", "2-3", None, 1e6, 8.3153160, 10.9687844),
    ("He-447", 447.150, "1s2p-1s4d", "2-3", "2.3P-4.3D", 0.24574e8, 20.96408703, 23.73609031),
    ("He-492", 492.193, "2p-4d", "*-*", "2.1P-4.1D", 0.19855e8, 0, 0),
    ("He-501", 501.568, "1s2s-1s3p", "0-1", "2.1S-3.1P", 0.13368e8, 20.61577496, 23.08701866),
    ("He-504", 504.774, "1s2p-1s4s", "1-0", "2.3S-3.3P", 0.06768e8, 21.21802284, 23.67357071),
    ("He-587", 587.566, "1s2p-1s3d", "2-3", "2.3P-3.3D", 0.70693e8, 20.96408703, 23.07365084),
    ("He-667", 667.815, "1s2p-1s3d", "1-2", "2.1P-3.1D", 0.63676e8, 21.21802284, 23.07407493),
    ("He-706", 706.525, "1s2p-1s3s", "2-1", "2.3P-3.3S", 0.27849e8, 20.96408703, 22.71846655),
    ("He-728", 728.135, "2p-3s", "*-*", "2.1P-3.1S", 0.18291e8, 21.21802284, 22.92031749),
    ("H-alpha", 656.279, "2s-3s", "*-*", "2-3", 4.4101e7, 12.0875051, 10.1988357),
    ("H-alpha", 656.098629, "2s-3s", "*-*", "2-3", 4.4114e7, 12.09079461, 10.20160487),
    ("H-beta", 486.135, "2s-4s", "*-*", "2-4", 8.4193e6, 12.7485392, 10.1988357),
    ("H-beta", 486.00013, "2s-4s", "*-*", "2-4", 8.4217e6, 12.75200754, 10.20160487),
    ("H-gamma", 434.0472, "2s-5s", "*-*", "2-5", 2.5304e6, 13.0545016, 10.1988357),
    ("H-gamma", 433.92833, "2s-5s", "*-*", "2-5", 2.5311e6, 13.05805386, 10.20160487),
    ("H-delta", 410.1734, "2s-6s", "*-*", "2-6", 9.7320e5, 13.22070378, 10.1988357),
]

# Band, lower and upper bound in nm. Bands not named here take
# the centre table below, or their mean wavelength with 0.3 nm on each side.
BOUNDS = [
    ("CIV-580", 579.95, 580.35),
    ("CIV-706", 706.3, 706.845),
    ("CIII-464", 464.55, 464.92),
    ("CIV-465", 465.50, 466.10),
    ("Xe-467", 467.0, 467.25),
    ("Xe-461", 461.05, 461.3),
    ("Xe-462", 462.3, 462.55),
    ("He-501", 501.4, 501.8),
    ("He-706", 706.4, 706.75),
    ("He-728", 727.92, 728.4),
    ("H-alpha", 655.8, 656.6),
    ("H-beta", 485.8, 486.35),
    ("H-gamma", 433.75, 434.2),
    ("H-delta", 409.8, 410.4),
    ("CHD-band", 429, 431.5),
]

# Band, centre in nm, widened by ``dw`` on each side.
CENTRES = [
    ("CIV-444", 444.1),
    ("CIV-465", 465.8),
    ("CIV-547", 547.05),
    ("CIV-580", 580.18),
    ("CIV-706", 706.35),
    ("CIV-772", 772.62),
]

# The groups in output order.
GROUPS = {
    "hydrogen": ["H-alpha", "H-beta", "H-gamma", "H-delta"],
    "helium": ["He-447", "He-492", "He-501", "He-504", "He-587", "He-667", "He-706", "He-728"],
    "carbon": ["CII-515", "CIII-464", "CIV-580", "CIV-444", "CIV-465", "CIV-772", "CIV-706", "CIV-547"],
    "molecular": ["CHD-band"],
    "xenon": ["Xe-461", "Xe-462", "Xe-467"],
}
FITTED_GROUPS = ["carbon", "helium"]
OUTPUT_GROUPS = ["hydrogen", "helium", "carbon", "molecular"]


def band_lines(spark):
    """Catalogue lines ``(band, line, wl, config, j, term, ak, e_low, e_high)``; 43 rows."""
    rows, seen = [], {}
    for band, wl, config, j, term, ak, low, high in LINES:
        seen[band] = seen.get(band, -1) + 1
        rows.append((band, seen[band], float(wl), config, j, term, float(ak), float(low), float(high)))
    return spark.createDataFrame(rows, (
        "band string, line long, wl double, config string, j string, term string, "
        "ak double, e_low double, e_high double"))


def bound_overrides(spark):
    """Fixed bounds ``(band, lo, hi)``."""
    return spark.createDataFrame(
        [(b, float(lo), float(hi)) for b, lo, hi in BOUNDS], "band string, lo double, hi double")


def band_centres(spark):
    return spark.createDataFrame([(b, float(c)) for b, c in CENTRES], "band string, centre double")


def band_groups(spark):
    """``(grp, band, pos, fit)``: group membership in output order."""
    rows = [(g, b, i, g in FITTED_GROUPS) for g, bands in GROUPS.items() for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, "grp string, band string, pos long, fit boolean")


def bands_in(bands, groups, *names):
    """Bands that belong to the named groups."""
    return bands.join(groups.where(F.col("grp").isin(*names)), "band", "left_semi")
