"""Synthetic raw survey rows (test code only) with the edge cases of FIXTURES.md §1."""

from __future__ import annotations

import numpy as np

from surveylens.functions import presets as P

AS_OF_YEAR = 2025

ISO_ROWS = [
    ("US", "USA", "United States", "North America"),
    ("GB", "GBR", "United Kingdom", "Europe"),
    ("DE", "DEU", "Germany", "Europe"),
    ("FR", "FRA", "France", "Europe"),
    ("NA", "NAM", "Namibia", "Africa"),
    ("JP", "JPN", "Japan", "Asia"),
    ("BR", "BRA", "Brazil", "South America"),
    ("AU", "AUS", "Australia", "Oceania"),
    ("AQ", "ATA", "Antarctica", None),
]


def iso_dim(spark):
    return spark.createDataFrame(ISO_ROWS, "alpha2 string, alpha3 string, name string, "
                                           "continent string")


def raw_columns():
    cols = list(P.DASS_ITEMS) + list(P.TIPI_ITEMS) + list(P.VCL_ITEMS)
    cols += list(P.RECODE_SPEC) + ["age", "country", "familysize", "free_text", "device"]
    return cols


def raw_rows(n: int = 400, seed: int = 7):
    rng = np.random.default_rng(seed)
    countries = ["US", "GB", "DE", "FR", "NA", "JP", "BR", "AU", "US", "GB", "DE", "FR", "US", "JP",
                 "BR", "AQ", "us", "NONE", "ZZ", None]
    rows = []
    for i in range(n):
        r = {}
        base = rng.integers(1, 5)
        for q in P.DASS_ITEMS:
            r[q] = int(np.clip(base + rng.integers(-1, 2), 1, 4))
        for t in P.TIPI_ITEMS:
            r[t] = int(rng.integers(1, 8))
        for v in P.VCL_ITEMS:
            r[v] = int(rng.integers(0, 2)) if v not in P.VCL_FAKE else int(rng.random() < 0.05)
        r["gender"] = int(rng.integers(0, 4))
        r["education"] = int(rng.integers(0, 5))
        r["urban"] = int(rng.integers(0, 4))
        r["religion"] = int(rng.integers(0, 13))
        r["orientation"] = int(rng.integers(0, 6))
        r["race"] = int(rng.choice([0, 10, 20, 30, 40, 50, 60, 70]))
        r["hand"] = int(rng.integers(0, 4))
        r["voted"] = int(rng.integers(0, 3))
        r["married"] = int(rng.integers(0, 4))
        r["engnat"] = int(rng.integers(0, 3))
        r["screensize"] = int(rng.integers(0, 3))
        r["uniquenetworklocation"] = int(rng.integers(0, 3))
        r["source"] = int(rng.integers(0, 4))
        r["age"] = int(rng.integers(13, 70)) if rng.random() < 0.8 else int(rng.integers(1950, 2008))
        r["country"] = countries[i % len(countries)]
        r["familysize"] = int(rng.integers(0, 6))
        r["free_text"] = "note" if rng.random() < 0.5 else None   # > 20 % null: dropped column
        r["device"] = "phone" if rng.random() < 0.95 else None    # <= 20 % null: drops rows
        rows.append(r)
    # edge rows
    edge = dict(rows[0])
    rows.append({**edge, "gender": 9})                     # unmapped code
    rows.append({**edge, "gender": None})                  # null code
    rows.append({**edge, "age": 9})                        # too young
    rows.append({**edge, "age": 10})
    rows.append({**edge, "age": 100})
    rows.append({**edge, "age": 101})                      # too old
    rows.append({**edge, "age": 1900})                     # birth year 1900 -> 125 -> dropped
    rows.append({**edge, "age": AS_OF_YEAR - 10})          # birth year -> age 10
    rows.append({**edge, "Q2A": None})                     # one null item
    rows.append({**edge, "TIPI1": 0, "TIPI6": 0})          # zero pair still in range
    rows.append({**edge, "VCL6": 1})                       # fake word checked
    return rows


def raw_frame(spark, n: int = 400, seed: int = 7):
    cols = raw_columns()
    schema = ", ".join(f"`{c}` string" if c in ("country", "free_text", "device") else f"`{c}` bigint"
                       for c in cols)
    data = [tuple(r.get(c) for c in cols) for r in raw_rows(n, seed)]
    return spark.createDataFrame(data, schema)
