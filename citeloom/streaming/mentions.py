"""STM07: mentions of a publication accumulated over a stream, as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def accumulated(stream: DataFrame, key: str = "publication_id", mention: str = "dataset_id") -> DataFrame:
    """``key, n_mentions, new_mentions``: for each batch and publication, how many distinct mentions it has by now and how many are new.

    The state holds a publication's distinct mentions, as its document does.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(json.loads(state.get[0])) if state.exists else set()
        before = len(seen)
        for b in batches:
            seen |= set(b[mention].dropna())
        state.update((json.dumps(sorted(seen)),))
        yield pd.DataFrame({key: [k[0]], "n_mentions": [len(seen)], "new_mentions": [len(seen) - before]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} string, n_mentions int, new_mentions int", "mentions string", "update", GroupStateTimeout.NoTimeout)
