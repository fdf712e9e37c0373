"""The nearest known place."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaweave.functions import scalars as S
from mediaweave.operators.pairs import grid_columns, grid_row, near_cells, own_cell
from mediaweave.sources.shared import publish

FIRST_CELL, WIDER, WHOLE = 0.02, 4, 45.0
METRES_PER_DEGREE = 111_000
#: Cells of the last round, of which the globe has a few thousand; no point of one is farther from its centre than that.
COARSE, REACH = 5.0, 450_000.0
#: Places that are nearer to each other than that are equally near.
TIE_DIGITS = 6


def _coarse_centres(cells: pd.DataFrame) -> pd.DataFrame:
    lat = (cells["cell_row"] + 0.5) * COARSE
    return cells.assign(lat=lat, lon=(cells["cell_column"] + 0.5) / cells["columns"] * 360 - 180)


def _reachable(batches, cells):
    """For each spot the coarse cells that may hold its nearest place: none of the others can be as near."""
    c = cells.value
    lat, lon = np.radians(c["lat"].to_numpy()), np.radians(c["lon"].to_numpy())
    for df in batches:
        a, b = np.radians(df["lat"].to_numpy())[:, None], np.radians(df["lon"].to_numpy())[:, None]
        h = np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2
        metres = 2 * 6_371_000 * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        spot, cell = np.nonzero(metres - REACH <= metres.min(1, keepdims=True) + REACH)
        yield pd.DataFrame({"lat": df["lat"].to_numpy()[spot], "lon": df["lon"].to_numpy()[spot], "cell_row": c["cell_row"].to_numpy()[cell], "cell_column": c["cell_column"].to_numpy()[cell]})


def far_pairs(spots: DataFrame, places: DataFrame) -> DataFrame:
    """Spots joined with the places of all coarse cells that may hold their nearest. Only the occupied cells, a few
    thousand at most on the whole globe, go to every task."""
    row, column = own_cell(F.col("place_lat"), F.col("place_lon"), COARSE)
    placed = places.select("*", row, column, grid_columns(grid_row(F.col("place_lat"), COARSE), COARSE).alias("columns"))
    cells = _coarse_centres(placed.select("cell_row", "cell_column", "columns").distinct().toPandas())
    shared = spots.sparkSession.sparkContext.broadcast(cells)
    reach = spots.select("lat", "lon").mapInPandas(partial(_reachable, cells=shared), "lat double, lon double, cell_row long, cell_column long")
    return reach.join(placed.drop("columns"), ["cell_row", "cell_column"])


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """points: id, lat, lon; places: place_id, lat, lon and what else is known of a place (name, country, region). The
    nearest place by great circle, ties (to a micrometre) to the smaller place_id: id, place_id, metres and the place's
    other columns. Points without both coordinates are left out.

    Distinct spots are looked up once, and of places at one spot only the smallest place_id, which wins their tie. A round joins them with the places of the cells around; what is found within a
    cell's height is the nearest, and the rest goes on with cells four times as high. Spots that are over 2,000 km from
    every place meet those of the coarse cells that can hold the nearest."""
    located = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon")
    spots = publish(located.select("lat", "lon").distinct())
    told = places.drop("lat", "lon")
    places = publish(places.groupBy(F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon")).agg(F.min("place_id").alias("place_id")))
    cell, done = FIRST_CELL, []
    metres = S.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    best = F.min(F.struct(F.round(metres, TIE_DIGITS).alias("tie"), F.col("place_id"), metres.alias("metres"))).alias("best")
    while True:
        last = cell > WHOLE
        if last:
            pairs = far_pairs(spots, places)
        else:
            pairs = near_cells(spots, "lat", "lon", cell).join(places.select("*", *own_cell(F.col("place_lat"), F.col("place_lon"), cell)), ["cell_row", "cell_column"])
        found = pairs.groupBy("lat", "lon").agg(best).select("lat", "lon", "best.place_id", "best.metres")
        found = publish(found if last else found.filter(F.col("metres") <= cell * METRES_PER_DEGREE))
        done.append(found)
        if last:
            break
        spots = publish(spots.join(found, ["lat", "lon"], "left_anti"))
        if spots.isEmpty():
            break
        cell *= WIDER
    known = reduce(DataFrame.unionByName, done).join(told, "place_id")
    return located.join(known, ["lat", "lon"]).select("id", "place_id", "metres", *(c for c in told.columns if c != "place_id"))
