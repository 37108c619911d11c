"""Invented entries; the results that tests expect of them were computed outside the library."""

from pyspark.sql import functions as F

from signpost.operators.entries import normalize_entries
from signpost.schema import RAW_ENTRY

AS_OF = F.lit("2024-02-01 00:00:00").cast("timestamp")

FIVE = [
    {"name": "water_beds", "description": "Open garden valves that soak raised beds at dawn", "category": "irrigation",
     "tags": ["hose", "valve"], "triggers": ["irrigate", "sprinkle"]},
    {"name": "prune_roses", "description": "Cut rose stems back before frost reaches the garden", "category": "pruning",
     "tags": ["rose", "stem", "shears"], "triggers": ["prune", "trim"]},
    {"name": "soil_survey",
     "description": "Measure acidity, moisture and salt of soil samples taken across the garden, then chart each plot "
                    "beside last year",
     "category": "survey", "tags": ["soil", "acidity", "plot"], "triggers": ["soil", "survey", "surveyor"]},
    {"name": "sow_seeds", "description": "Place seeds in trays by variety and soil warmth for the garden", "category": "sowing",
     "tags": ["seeds", "tray"], "triggers": ["sow", "plant"]},
    {"name": "count_bees", "description": "Tally bees at garden hives", "category": "wildlife",
     "tags": ["hive", "pollen"], "triggers": ["bees"]},
]

SIXTH = {"name": "brew_night_tea",
         "description": "Steeps chamomile under moonlight for sleepless lighthouse keepers",
         "category": "misc", "tags": ["herb"]}

MANIFEST = {
    "provider": "harbour-desk",
    "tools": [
        {"name": "moor_boat", "description": "Assign a berth to an arriving vessel", "category": "communication",
         "triggers": ["berth", "moor"], "tags": ["quay", "vessel"],
         "boostKeywords": "anchorage pontoon slip",
         "inputSchema": {"type": "object", "properties": {
             "vessel": {"type": "string"}, "length": {"type": "number"}, "arrival": {"type": "string"}}}},
        {"name": "tide_table", "description": "List high and low water for a chosen day", "category": "data",
         "triggers": ["tide", "ebb"], "tags": ["moon", "water"], "boostKeywords": "flood spring neap"},
        {"name": "fuel_order", "description": "Book diesel delivery alongside the quay", "category": "dev",
         "triggers": ["diesel", "bunker"], "tags": ["fuel"], "boostKeywords": "refill tank litres"},
        {"name": "weather_brief", "description": "Summarise wind, swell and visibility for skippers", "category": "ai",
         "triggers": ["wind", "storm"], "tags": ["forecast"], "boostKeywords": "gale warning pressure"},
    ],
}


def raw(spark, rows):
    extra = sorted({k for r in rows for k in r} - set(RAW_ENTRY.names))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_ENTRY.fields)
    ddl += "".join(f", {c} {'long' if c == 'seq' else 'string'}" for c in extra)
    names = RAW_ENTRY.names + extra
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def entries(spark, rows):
    return normalize_entries(raw(spark, rows), AS_OF)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")
