"""Slots for model results, which are input columns here: a provider turns a frame into columns; only a mock one is included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a slot -> function of a DataFrame that returns it with the model's columns.
_providers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def provide(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """Register a model's columns: shots, words, captions, embeddings, sound events or faces."""
    _providers[name] = f


def provider(name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return _providers[name]
    except KeyError:
        raise LookupError(f"no provider of {name}: models and media decoders are not part of this library") from None


def mock_captioner(scene: Column, label: Column) -> Column:
    """A caption made of what is known already, for tests and dry runs."""
    return F.concat(F.lit("scene "), scene.cast("string"), F.lit(": "), label)


provide("captions", lambda df: df.withColumn("caption", mock_captioner(F.col("scene_id"), F.col("event_type"))))
