"""Word lists and tables that decide scores."""

# Shrink-swell susceptibility by formation name; the first match wins.
FORMATIONS = (
    ("LONDON CLAY", 1.00),
    ("THAMES GROUP", 1.00),
    ("GAULT", 0.90),
    ("WEALD CLAY", 0.90),
    ("OXFORD CLAY", 0.90),
    ("KIMMERIDGE CLAY", 0.90),
    ("AMPTHILL CLAY", 0.90),
    ("ANCHOLME GROUP", 0.85),
    ("BARTON GROUP", 0.85),
    ("BRACKLESHAM", 0.80),
    ("LAMBETH GROUP", 0.75),
    ("WEALDEN GROUP", 0.75),
    ("HASTINGS", 0.60),
    ("LIAS GROUP", 0.55),
    ("MERCIA MUDSTONE", 0.45),
    ("OSGODBY", 0.55),
    ("CORALLIAN", 0.40),
    ("GREAT OOLITE", 0.30),
)

# Then by rock type, scaled down unless the rock is young.
ROCK_TYPES = (
    ("CLAY", 0.70),
    ("MUDSTONE", 0.40),
    ("SILTSTONE", 0.25),
    ("MUD", 0.40),
    ("ARGILLACEOUS", 0.35),
)
YOUNG_PERIODS = (
    "TRIASSIC", "JURASSIC", "CRETACEOUS", "PALAEOGENE",
    "PALEOGENE", "NEOGENE", "TERTIARY", "QUATERNARY",
)
OLD_ROCK_FACTOR = 0.3
OTHER_ROCK = 0.08

# Superficial deposits: a closed list, and the two that are left out on purpose.
DEPOSITS = {
    "LACUSTRINE DEPOSITS (UNDIFFERENTIATED)": 0.75,
    "CLAY-WITH-FLINTS": 0.70,
    "BRICKEARTH": 0.60,
    "LANDSLIP": 0.55,
    "ALLUVIUM": 0.50,
    "TILL": 0.45,
    "RAISED MARINE DEPOSITS (UNDIFFERENTIATED)": 0.30,
    "CRAG GROUP": 0.10,
    "GLACIAL SAND AND GRAVEL": 0.05,
    "RIVER TERRACE DEPOSITS (UNDIFFERENTIATED)": 0.05,
    "SAND AND GRAVEL OF UNCERTAIN AGE AND ORIGIN": 0.05,
    "BLOWN SAND": 0.05,
}
DEPOSITS_LEFT_OUT = ("PEAT", "DRIFT GEOLOGY NOT MAPPED [FOR DIGITAL MAP USE ONLY]")
NO_CLAY = "none (low-plasticity bedrock)"
NO_DRIFT = "none mapped"
DRIFT_WEIGHT = 0.5
CLAY_FROM = 0.4
