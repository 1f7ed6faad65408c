"""Balanced, repaired and standardised panel from the four daily feeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltweave.functions.fixed import DROPPED_VARIABLES
from voltweave.operators import impute, panel
from voltweave.runtime import cut

SERIES = ["country", "variable"]


@dataclass(frozen=True)
class Panel:
    """Endogenous and exogenous series (date, country, variable, value, mean, std, z) and countries."""

    endogenous: DataFrame
    exogenous: DataFrame
    countries: DataFrame


def _zero_filled(feed: DataFrame) -> DataFrame:
    """Feeds whose pivot shows 0 where a country reports nothing on a day of the feed."""
    return panel.on_calendar(feed, feed.select("date")).fillna(0.0, ["value"])


def assemble(
    generation: DataFrame, load: DataFrame, price: DataFrame, reserve: DataFrame, countries: DataFrame,
    dropped: list[str] = DROPPED_VARIABLES,
) -> Panel:
    """Daily feeds (date, country, variable, value) to the model panel.

    ``countries`` is the ordered candidate list (idx, country). Daily feeds are small next to the raw
    readings and are read several times, so they are materialised first.
    """
    generation, load, price, reserve = (
        cut(f.select("date", *SERIES, "value")) for f in (generation, load, price, reserve))
    included = panel.included_countries(countries, price, load)
    calendar = cut(panel.common_calendar([generation, load, price, reserve]))

    def aligned(feed: DataFrame) -> DataFrame:
        inside = feed.join(included.select("country"), "country", "left_semi")
        return panel.on_calendar(inside, calendar).select("date", *SERIES, "value")

    y = aligned(price).unionByName(aligned(_zero_filled(load)))
    x = aligned(_zero_filled(generation)).unionByName(aligned(reserve))
    y = cut(impute.impute(y, SERIES))
    x = cut(panel.drop_columns(impute.impute(x, SERIES), dropped))
    return Panel(panel.standardise(y, SERIES, strict=True), panel.standardise(x, SERIES, strict=False), included)


def scaling(standardised: DataFrame) -> DataFrame:
    """Mean and standard deviation per series, for the way back to the original units."""
    return standardised.groupBy(*SERIES).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
