"""The short way in: `load("english AND first sources", tables, vocabulary)`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators import predicate as P


@dataclass(frozen=True)
class Loaded:
    """Objects and frames of a query, with the terms it was understood as."""

    objects: DataFrame
    frames: DataFrame
    terms: list[str]
    predicate: dict


def load(query: str, objects: DataFrame, frames: DataFrame, sessions: DataFrame, vocabulary: dict, sealed: DataFrame | None = None) -> Loaded:
    """Resolves a query of terms; with `sealed` (frame_id), only frames of that version."""
    predicate, terms = P.compile_terms(query, vocabulary)
    if sealed is not None:
        frames = frames.join(sealed, "frame_id", "left_semi")
        objects = objects.join(sealed, "frame_id", "left_semi")
    found = P.select_objects(objects, frames, sessions, predicate)
    return Loaded(found, P.select_frames(objects, frames, sessions, predicate), terms, predicate)
