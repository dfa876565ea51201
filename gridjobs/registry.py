"""The registry of balancing authorities (BAs): a small dimension table that joins broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import REGISTRY

# Code, name, interconnect, UTC offset, weather station, publishes demand, organised market, longitude,
# latitude, approximate peak in MW.
ROWS = [
    ("PJM", "PJM Interconnection", "Eastern", -5, "DCA", True, True, -79.0, 39.5, 165500),
    ("CISO", "California ISO", "Western", -8, "SFO", True, True, -119.4, 36.8, 52000),
    ("ERCO", "ERCOT", "Texas", -6, "AUS", True, True, -99.0, 31.0, 85500),
    ("MISO", "Midcontinent ISO", "Eastern", -6, "MSP", True, True, -91.0, 43.0, 127000),
    ("NYIS", "New York ISO", "Eastern", -5, "JFK", True, True, -75.5, 43.0, 32500),
    ("ISNE", "ISO New England", "Eastern", -5, "BOS", True, True, -71.5, 43.7, 26000),
    ("SWPP", "Southwest Power Pool", "Eastern", -6, "OKC", True, True, -98.5, 37.0, 56000),
    ("SOCO", "Southern Company", "Eastern", -6, "ATL", True, False, -84.4, 33.0, 40000),
    ("TVA", "Tennessee Valley Authority", "Eastern", -6, "BNA", True, False, -86.3, 35.5, 34000),
    ("DUK", "Duke Energy Carolinas", "Eastern", -5, "CLT", True, False, -81.0, 35.3, 23000),
    ("CPLE", "Duke Energy Progress East", "Eastern", -5, "RDU", True, False, -78.8, 35.9, 14000),
    ("CPLW", "Duke Energy Progress West", "Eastern", -5, "AVL", True, False, -82.5, 35.6, 2300),
    ("LGEE", "Louisville Gas & Electric / Kentucky Utilities", "Eastern", -5, "SDF", True, False, -85.8, 38.0, 8000),
    ("AECI", "Associated Electric Cooperative", "Eastern", -6, "SGF", True, False, -93.3, 37.2, 4000),
    ("SCEG", "Dominion Energy South Carolina", "Eastern", -5, "CAE", True, False, -81.1, 34.0, 5500),
    ("SC", "Santee Cooper", "Eastern", -5, "MYR", True, False, -79.5, 33.7, 5000),
    ("FPL", "Florida Power & Light", "Eastern", -5, "MIA", True, False, -80.7, 27.3, 25000),
    ("FPC", "Duke Energy Florida", "Eastern", -5, "MCO", True, False, -82.3, 28.8, 12000),
    ("TEC", "Tampa Electric", "Eastern", -5, "TPA", True, False, -82.4, 28.0, 4600),
    ("FMPP", "Florida Municipal Power Pool", "Eastern", -5, "ORL", True, False, -81.3, 28.5, 3500),
    ("SEC", "Seminole Electric Cooperative", "Eastern", -5, "OCF", True, False, -82.2, 28.8, 2500),
    ("JEA", "JEA (Jacksonville)", "Eastern", -5, "JAX", True, False, -81.7, 30.3, 3200),
    ("TAL", "City of Tallahassee", "Eastern", -5, "TLH", True, False, -84.3, 30.4, 650),
    ("GVL", "Gainesville Regional Utilities", "Eastern", -5, "GNV", True, False, -82.3, 29.7, 450),
    ("HST", "City of Homestead", "Eastern", -5, "TMB", True, False, -80.4, 25.5, 100),
    ("BPAT", "Bonneville Power Administration", "Western", -8, "PDX", True, False, -121.5, 45.5, 12000),
    ("PACE", "PacifiCorp East", "Western", -7, "SLC", True, False, -111.9, 40.8, 7500),
    ("PACW", "PacifiCorp West", "Western", -8, "MFR", True, False, -122.9, 42.5, 3500),
    ("AZPS", "Arizona Public Service", "Western", -7, "PHX", True, False, -112.1, 33.4, 8500),
    ("SRP", "Salt River Project", "Western", -7, "IWA", True, False, -111.9, 33.4, 8000),
    ("PSCO", "Public Service Company of Colorado", "Western", -7, "DEN", True, False, -104.7, 39.9, 8000),
    ("NEVP", "Nevada Power", "Western", -8, "LAS", True, False, -115.2, 36.1, 7500),
    ("LDWP", "LA Dept of Water and Power", "Western", -8, "BUR", True, False, -118.4, 34.2, 6500),
    ("PGE", "Portland General Electric", "Western", -8, "SLE", True, False, -122.6, 45.3, 4000),
    ("IPCO", "Idaho Power", "Western", -7, "BOI", True, False, -116.2, 43.6, 3700),
    ("PSEI", "Puget Sound Energy", "Western", -8, "SEA", True, False, -122.3, 47.4, 5000),
    ("SCL", "Seattle City Light", "Western", -8, "BFI", True, False, -122.3, 47.5, 1800),
    ("TPWR", "Tacoma Power", "Western", -8, "TIW", True, False, -122.6, 47.1, 850),
    ("AVA", "Avista Corporation", "Western", -8, "GEG", True, False, -117.5, 47.6, 1800),
    ("NWMT", "NorthWestern Energy (Montana)", "Western", -7, "BIL", True, False, -108.5, 46.0, 1900),
    ("PNM", "Public Service Company of New Mexico", "Western", -7, "ABQ", True, False, -106.6, 35.1, 2200),
    ("EPE", "El Paso Electric", "Western", -7, "ELP", True, False, -106.4, 31.8, 2200),
    ("TEPC", "Tucson Electric Power", "Western", -7, "TUS", True, False, -110.9, 32.1, 3000),
    ("WACM", "WAPA Rocky Mountain Region", "Western", -7, "CYS", True, False, -105.2, 42.0, 3500),
    ("WALC", "WAPA Desert Southwest Region", "Western", -7, "FLG", True, False, -113.0, 34.5, 2500),
    ("WAUW", "WAPA Upper Great Plains West", "Western", -7, "BIS", True, False, -101.0, 46.0, 700),
    ("BANC", "Balancing Authority of Northern California", "Western", -8, "SMF", True, False, -121.5, 38.5, 3300),
    ("TIDC", "Turlock Irrigation District", "Western", -8, "MOD", True, False, -120.8, 37.5, 620),
    ("IID", "Imperial Irrigation District", "Western", -8, "IPL", True, False, -115.5, 33.0, 1000),
    ("DOPD", "Douglas County PUD", "Western", -8, "EPH", True, False, -120.2, 47.8, 200),
    ("CHPD", "Chelan County PUD", "Western", -8, "EAT", True, False, -120.3, 47.4, 350),
    ("GCPD", "Grant County PUD", "Western", -8, "MWH", True, False, -119.3, 47.1, 550),
    ("SPA", "Southwestern Power Administration", "Eastern", -6, "LIT", True, False, -92.3, 34.8, 1500),
    ("SEPA", "Southeastern Power Administration", "Eastern", -5, "AGS", False, False, -82.0, 33.4, None),
    ("YAD", "Alcoa Power Generating - Yadkin", "Eastern", -5, "INT", False, False, -80.2, 35.7, None),
    ("GLHB", "GridLiance", "Eastern", -6, "MSY", False, False, -90.3, 30.0, None),
    ("NSB", "New Smyrna Beach", "Eastern", -5, "DAB", False, False, -80.9, 29.0, None),
    ("AEC", "PowerSouth Energy Cooperative", "Eastern", -6, "MGM", False, False, -86.6, 31.9, None),
    ("EEI", "Electric Energy, Inc.", "Eastern", -6, "PAH", False, False, -89.0, 37.1, None),
    ("SIKE", "Sikeston Board of Municipal Utilities", "Eastern", -6, "CGI", False, False, -89.6, 36.9, None),
    ("GWA", "NaturEner Power Watch (MT)", "Western", -7, "GTF", False, False, -111.3, 48.5, None),
    ("WWA", "NaturEner Wind Watch (MT)", "Western", -7, "GTF", False, False, -111.3, 48.5, None),
    ("HGMA", "Harquahala Generating", "Western", -7, "BXK", False, False, -113.1, 33.5, None),
    ("GRIF", "Griffith Energy", "Western", -7, "IFP", False, False, -114.6, 35.1, None),
    ("GRID", "Gridforce Energy Management", "Western", -7, "PHX", False, False, -112.0, 33.4, None),
    ("DEAA", "Arlington Valley (AZ)", "Western", -7, "PHX", False, False, -113.0, 33.2, None),
    ("AVRN", "Avangrid Renewables", "Western", -8, "PDT", False, False, -119.0, 45.7, None),
]

# Fixed values: (latitude, longitude) of the load centres of the organised markets.
LOAD_CENTRES = {
    "PJM": [(39.95, -75.16), (38.90, -77.04), (41.88, -87.63), (40.44, -79.996), (39.29, -76.61), (40.74, -74.17)],
    "CISO": [(34.05, -118.24), (37.77, -122.42), (32.72, -117.16), (38.58, -121.49), (36.75, -119.77)],
    "ERCO": [(29.76, -95.37), (32.78, -96.80), (30.27, -97.74), (29.42, -98.49), (31.76, -106.49)],
    "MISO": [(44.98, -93.27), (42.33, -83.05), (38.63, -90.20), (39.77, -86.16), (43.04, -87.91)],
    "NYIS": [(40.71, -74.01), (42.89, -78.88), (42.65, -73.76), (43.16, -77.61)],
    "ISNE": [(42.36, -71.06), (41.76, -72.69), (41.82, -71.41), (43.66, -70.26), (42.10, -72.59)],
    "SWPP": [(39.10, -94.58), (35.47, -97.52), (41.26, -95.93), (36.15, -95.99), (37.69, -97.34)],
}


def registry(spark: SparkSession) -> DataFrame:
    """All 67 BAs with their position in the registry."""
    rows = [(i, code, name, inter, offset, station, demand, rto, (lon, lat), peak) for i, (code, name, inter, offset, station, demand, rto, lon, lat, peak) in enumerate(ROWS)]
    return spark.createDataFrame(rows, REGISTRY)


def select(reg: DataFrame, codes: list[str] | None = None, has_demand: bool | None = None, is_rto: bool | None = None, interconnect: str | None = None) -> DataFrame:
    """Registry rows by flags and codes, in registry order; unknown codes are dropped."""
    out = reg
    if codes is not None:
        out = out.where(F.col("code").isin([c.upper() for c in codes]))
    for column, value in (("has_demand", has_demand), ("is_rto", is_rto), ("interconnect", interconnect)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("position")


def lookup(rows: DataFrame, reg: DataFrame, key: str = "ba") -> DataFrame:
    """Add the BA's name, interconnect, offset and peak; rows of unknown BAs stay with nulls."""
    side = reg.select(F.col("code").alias(key), "name", "interconnect", "utc_offset", "peak_mw", "is_rto")
    return rows.join(F.broadcast(side), key, "left")


def load_centres(spark: SparkSession, reg: DataFrame) -> DataFrame:
    """Rows (ba, lat, lon): the load centres, or the centroid where none are listed."""
    listed = spark.createDataFrame([(b, [*c]) for b, c in LOAD_CENTRES.items()], "ba string, centres array<struct<lat: double, lon: double>>")
    joined = reg.select(F.col("code").alias("ba"), "centroid").join(F.broadcast(listed), "ba", "left")
    own = F.array(F.struct(F.col("centroid.lat").alias("lat"), F.col("centroid.lon").alias("lon")))
    return joined.select("ba", F.explode(F.coalesce("centres", own)).alias("c")).select("ba", "c.lat", "c.lon")
