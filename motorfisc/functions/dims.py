"""Brackets, vocabularies and thresholds that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the law: price from, price to, fixed amount, rate; registered before and from 2021.
VALUE_NEDC = [
    ("0", "13272.28", "0", "0.00"),
    ("13272.29", "19908.42", "0", "0.00"),
    ("19908.43", "26544.56", "265.45", "0.03"),
    ("26544.57", "33180.70", "464.53", "0.05"),
    ("33180.71", "39816.84", "796.34", "0.07"),
    ("39816.85", "46452.98", "1260.87", "0.09"),
    ("46452.99", "53089.12", "1858.12", "0.11"),
    ("53089.13", "59725.26", "2588.10", "0.13"),
    ("59725.27", "66361.40", "3450.79", "0.14"),
    ("66361.41", "72997.54", "4379.85", "0.15"),
    ("72997.55", "79633.69", "5375.27", "0.16"),
    ("79633.70", None, "6437.05", "0.17"),
]
VALUE_WLTP = [
    ("0", "13272.28", "0", "0.00"),
    ("13272.29", "19908.42", "0", "0.00"),
    ("19908.43", "26544.56", "0", "0.00"),
    ("26544.57", "33180.70", "398.17", "0.03"),
    ("33180.71", "39816.84", "597.25", "0.05"),
    ("39816.85", "46452.98", "929.06", "0.07"),
    ("46452.99", "53089.12", "1393.59", "0.09"),
    ("53089.13", "59725.26", "1990.84", "0.11"),
    ("59725.27", "66361.40", "2720.82", "0.13"),
    ("66361.41", "72997.54", "3583.51", "0.15"),
    ("72997.55", "79633.69", "4578.93", "0.16"),
    ("79633.70", None, "5640.71", "0.17"),
]
# Fixed values of the law: emission from, to, fixed amount, amount for each g/km.
ECO = {
    ("NEDC", "diesel"): [("70", "85", "24.55", "7.30"), ("85", "120", "134.05", "23.23"), ("120", "140", "947.10", "152.63"), ("140", "170", "3999.70", "165.90"), ("170", "200", "8976.70", "179.18"), ("200", None, "14352.10", "192.45")],
    ("NEDC", "petrol"): [("75", "90", "12.61", "4.65"), ("90", "120", "82.36", "17.92"), ("120", "140", "619.96", "59.73"), ("140", "170", "1814.56", "92.91"), ("170", "200", "4601.86", "159.27"), ("200", None, "9379.96", "172.54")],
    ("WLTP", "diesel"): [("95", "125", "11.28", "13.94"), ("125", "155", "429.48", "24.55"), ("155", "190", "1165.98", "146.00"), ("190", "215", "6275.98", "165.90"), ("215", "255", "10423.48", "179.18"), ("255", None, "17590.68", "205.72")],
    ("WLTP", "petrol"): [("95", "125", "3.32", "5.97"), ("125", "155", "182.42", "18.58"), ("155", "175", "739.82", "73.66"), ("175", "200", "2213.02", "96.22"), ("200", "240", "4618.52", "129.40"), ("240", None, "9794.52", "218.99")],
}
# Fixed values of the law: first month of each age bracket and the share of the tax still owed; the last one ends at 180.
DEPRECIATION = [
    (0, "0.96"), (1, "0.93"), (2, "0.90"), (3, "0.88"), (4, "0.86"), (5, "0.84"), (6, "0.82"), (7, "0.81"), (8, "0.80"), (9, "0.79"),
    (10, "0.78"), (11, "0.77"), (12, "0.7604"), (13, "0.7508"), (14, "0.7412"), (15, "0.7316"), (16, "0.7220"), (17, "0.7124"), (18, "0.7028"),
    (19, "0.6932"), (20, "0.6836"), (21, "0.6740"), (22, "0.6644"), (23, "0.65"), (24, "0.6358"), (26, "0.6216"), (28, "0.6074"), (30, "0.5932"),
    (32, "0.5790"), (34, "0.5648"), (36, "0.5506"), (38, "0.5364"), (40, "0.5222"), (42, "0.5080"), (44, "0.4938"), (46, "0.4796"), (48, "0.4636"),
    (51, "0.4476"), (54, "0.4316"), (57, "0.4156"), (60, "0.4006"), (64, "0.3856"), (68, "0.3706"), (72, "0.3526"), (78, "0.3346"), (84, "0.3166"),
    (90, "0.2986"), (96, "0.2806"), (102, "0.2626"), (108, "0.2446"), (114, "0.2266"), (120, "0.2172"), (132, "0.2112"), (144, "0.2052"), (156, "0.1992"),
    (168, "0.1932"),
]
LAST_MONTH, FROZEN_MONTH, LAST_SHARE, STEP_SHARE = 180, 360, "0.1932", "0.006"
WLTP_FROM = "2021-01-01"
HRK_PER_EUR, EURO_FROM = "7.53450", "2023-01-01"

# Price-list folders and the brands that each can hold.
FOLDER_BRANDS = {
    "audi-porsche-seat-škoda-volkswagen-cupra": ["Audi", "Porsche", "Seat", "Škoda", "Volkswagen", "Cupra"],
    "baic": ["BAIC"],
    "bmw-mini": ["BMW", "MINI"],
    "byd": ["BYD"],
    "chevrolet": ["Chevrolet"],
    "citroën-ds": ["Citroën", "DS"],
    "dacia": ["Dacia"],
    "fiat-lancia-alfa-romeo-abarth-jeep-maserati": ["Fiat", "Lancia", "Alfa Romeo", "Abarth", "Jeep", "Maserati"],
    "forthing": ["Forthing"],
    "foton": ["Foton"],
    "geely": ["Geely"],
    "honda": ["Honda"],
    "hyundai": ["Hyundai"],
    "infiniti": ["Infiniti"],
    "isuzu": ["Isuzu"],
    "jaguar": ["Jaguar"],
    "kia": ["Kia"],
    "land-rover": ["Land Rover"],
    "lexus": ["Lexus"],
    "lynkco": ["Lynk & Co"],
    "mazda": ["Mazda"],
    "mercedes-benz-smart": ["Mercedes-Benz", "smart"],
    "mg": ["MG"],
    "mitsubishi": ["Mitsubishi"],
    "nissan": ["Nissan"],
    "omoda-jaecoo": ["Omoda", "Jaecoo"],
    "opel": ["Opel"],
    "peugeot": ["Peugeot"],
    "renault": ["Renault"],
    "ssangyong": ["SsangYong"],
    "subaru": ["Subaru"],
    "suzuki": ["Suzuki"],
    "tata": ["Tata"],
    "toyota": ["Toyota"],
    "volvo": ["Volvo"],
}
# Other spellings of a brand.
BRAND_ALIASES = {
    "marcedes-benz": "Mercedes-Benz",
    "marcedes benz": "Mercedes-Benz",
    "mercedes": "Mercedes-Benz",
    "mercedes benz": "Mercedes-Benz",
    "mercedes-amg": "Mercedes-Benz",
    "mercedes amg": "Mercedes-Benz",
    "amg": "Mercedes-Benz",
    "benz": "Mercedes-Benz",
    "vw": "Volkswagen",
    "skoda": "Škoda",
    "landrover": "Land Rover",
    "land-rover": "Land Rover",
    "range rover": "Land Rover",
    "alfa": "Alfa Romeo",
    "alfa-romeo": "Alfa Romeo",
    "citroen": "Citroën",
    "lynk": "Lynk & Co",
    "lynkco": "Lynk & Co",
    "lynk&co": "Lynk & Co",
}

# Words of catalogue texts.
TOKEN_SYNONYMS = {"limousine": "sedan", "limuzina": "sedan", "berline": "sedan", "touring": "wagon", "estate": "wagon", "avant": "wagon", "karavan": "wagon", "kombi": "wagon", "tr": "tronic"}
DIESEL_WORDS = ["tdi", "tdci", "dci", "cdi", "cdti", "hdi", "bluehdi", "crdi", "bluetec", "multijet", "jtd", "d4d", "ddis", "diesel", "dizel"]
PETROL_WORDS = ["tfsi", "tsi", "fsi", "tce", "thp", "puretech", "vti", "ecoboost", "gdi", "tgdi", "mpi", "benzin", "benzina", "gasoline", "phev"]
MANUAL_WORDS = ["rucni", "manuell", "manual", "schaltgetriebe", "schalt"]
AUTO_WORDS = ["automatik", "automatski", "automatic", "tiptronic", "tip", "tronic", "stronic", "dsg", "pdk", "steptronic", "dct", "multitronic", "edc", "powershift"]
BODY_WORDS = ["wagon", "sportback", "coupe", "cabrio", "cabriolet", "roadster", "allroad", "gran", "fastback", "liftback", "suv", "cross"]
DRIVETRAIN_WORDS = ["quattro", "xdrive", "4matic", "allrad", "4motion", "awd", "4x4"]
BMW_NOISE = ["advantage", "sportpaket", "sportpaketa", "sportline", "steptronic", "automatic", "automatik", "paket", "packet", "package", "pro", "modern", "individual"]
TOYOTA_SYNONYMS = {"ts": "wagon", "hybrid": "hibrid"}
# Spellings of a listing's fuel that the tax knows.
TAX_FUEL = {
    "diesel": "diesel", "dizel": "diesel", "petrol": "petrol", "benzin": "petrol", "gasoline": "petrol", "lpg": "petrol", "cng": "petrol", "hybrid": "petrol",
    "electric": "electric", "elektrisch": "electric", "elektro": "electric",
}
LISTING_FUEL = {"diesel": "diesel", "dizel": "diesel", "petrol": "petrol", "benzin": "petrol", "gasoline": "petrol"}
CORPUS_FUEL = {"diesel": "diesel", "dizel": "diesel", "tdi": "diesel", "petrol": "petrol", "benzin": "petrol", "benzine": "petrol", "gasoline": "petrol", "hybrid": "petrol", "hibrid": "petrol", "plug-in hybrid": "petrol", "mild hybrid": "petrol"}
FUEL_LETTERS = {"D": "diesel", "B": "petrol", "MH": "petrol_hybrid", "H": "petrol_plug_in_hybrid", "E": "electric"}
FUEL_WORDS = {"dizel": "diesel", "diesel": "diesel", "benzin": "petrol", "petrol": "petrol", "elektro": "electric", "električni": "electric", "electric": "electric"}
NOISE_TOKENS = ["baureihe", "typ", "type", "klasse", "class", "serie", "series", "generation"]

# Points of the catalogue match and of the emission lookup.
MATCH = {"accept": 88.0, "margin": 6.0, "floor": 62.0, "k": 5, "model_threshold": 70.0, "model_penalty": 40.0, "trim_penalty": 10.0, "fuel_penalty": 35.0, "gearbox_penalty": 12.0, "body_penalty": 12.0}
POWER_RAMP, CO2_RAMP, YEAR_RAMP = (7.0, 25.0, 4.0, 25.0), (8.0, 40.0, 3.0, 15.0), (1.0, 6.0, 8.0, 27.0)
LOOKUP = {"text": 50.0, "power": 30.0, "displacement": 12.0, "fuel": 8.0, "power_exact": 3.0, "power_zero": 8.0, "power_drop": 25.0, "cc_exact": 60.0, "cc_zero": 300.0, "before": 3, "after": 18, "extra": 6.0, "extra_cap": 18.0, "designator": 25.0, "accept": 80.0, "margin": 5.0, "range": 30.0, "floor": 50.0, "k": 5}


def value_brackets(spark: SparkSession) -> DataFrame:
    """(standard, lo, hi, fixed, rate) as decimals; 24 rows."""
    rows = [(s, *r) for s, rs in (("NEDC", VALUE_NEDC), ("WLTP", VALUE_WLTP)) for r in rs]
    return _decimals(spark, rows, "v_standard string", "lo", "hi", "fixed", "rate", ("v_lo", "v_hi", "v_fixed", "v_rate"))


def eco_brackets(spark: SparkSession) -> DataFrame:
    """(standard, fuel, lo, hi, fixed, rate) as decimals; 24 rows."""
    rows = [(s, f, *r) for (s, f), rs in ECO.items() for r in rs]
    return _decimals(spark, rows, "e_standard string, e_fuel string", "lo", "hi", "fixed", "rate", ("e_lo", "e_hi", "e_fixed", "e_rate"))


def _decimals(spark: SparkSession, rows: list, head: str, lo: str, hi: str, fixed: str, rate: str, names: tuple) -> DataFrame:
    df = spark.createDataFrame(rows, f"{head}, {lo} string, {hi} string, {fixed} string, {rate} string")
    kinds = dict(zip((lo, hi, fixed, rate), ("decimal(12,2)", "decimal(12,2)", "decimal(12,2)", "decimal(7,2)"), strict=True))
    new = dict(zip((lo, hi, fixed, rate), names, strict=True))
    return df.select(*[df[c].cast(kinds[c]).alias(new[c]) if c in kinds else df[c] for c in df.columns])


def depreciation_brackets(spark: SparkSession) -> DataFrame:
    """(d_from, d_to, d_share): half-open months, up to 180."""
    ends = [m for m, _ in DEPRECIATION[1:]] + [LAST_MONTH]
    df = spark.createDataFrame([(m, e, s) for (m, s), e in zip(DEPRECIATION, ends, strict=True)], "d_from int, d_to int, share string")
    return df.select("d_from", "d_to", df["share"].cast("decimal(5,4)").alias("d_share"))
