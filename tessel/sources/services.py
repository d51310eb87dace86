"""Models and services as sources: any function from a batch of rows to a batch of results, with retries.

The client is made once in each Python worker by ``make``; a batch that is too long is cut in halves; a row that fails in
the end gives null, never an invented value.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class TooLong(Exception):
    """Raised by a client for an input that has to be shorter."""


def call_service(rows: DataFrame, make: Callable[[], Callable[[list], list]], column: str, out: str = "answer", retries: int = 3, wait: float = 0.5, batch: int = 64) -> DataFrame:
    """``rows`` with the client's answer for ``column`` as text."""

    def ask(client, items: list) -> list:
        for attempt in range(retries):
            try:
                return list(client(items))
            except TooLong:
                break
            except Exception:
                if attempt + 1 < retries:
                    time.sleep(wait * 2**attempt)
        if len(items) > 1:
            half = len(items) // 2
            return ask(client, items[:half]) + ask(client, items[half:])
        return [None]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            items, got = pdf[column].tolist(), []
            for k in range(0, len(items), batch):
                got += ask(client, items[k : k + batch])
            yield pdf.assign(**{out: got})

    return rows.mapInPandas(of, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, `{out}` string")


def embed(rows: DataFrame, make: Callable[[], Callable[[list], list]], column: str, out: str = "embedding") -> DataFrame:
    """``rows`` with the vector that the model gives for ``column``; the model is loaded once in each worker."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield pdf.assign(**{out: [None if v is None else list(map(float, v)) for v in model(pdf[column].tolist())]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(of, f"{fields}, `{out}` array<float>")
