"""The causal filter: country filter, in-degree, low in-degree events with their precursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from antecede.operators.events import EVENT_COLUMNS, touching_countries
from antecede.operators.precedence import low_in_degree


def causal_filter(events: DataFrame, codes: Sequence[str]) -> DataFrame:
    served = low_in_degree(touching_countries(events, codes))
    columns = [c for c in EVENT_COLUMNS if c in events.columns]
    return served.select(*columns, "causal_in_degree", "precursor_ids")
