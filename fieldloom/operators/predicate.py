"""The predicate vocabulary and the term language: dictionaries of clauses compiled to columns and semi joins.

Clauses are ANDed, the values of a list are ORed, a missing clause does not restrict, an unknown clause is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENE_AXES = ("weather", "time_of_day")
OBJECT_CLAUSES = {"class_names", "l1", "states", "sources", "min_conf", "max_conf", "object_tags"}
FRAME_CLAUSES = {*SCENE_AXES, "frame_ids", "session_ids", "cities", "frame_tags"}


class UnknownClause(ValueError):
    pass


def checked(predicate: dict) -> dict:
    unknown = predicate.keys() - OBJECT_CLAUSES - FRAME_CLAUSES
    if unknown:
        raise UnknownClause(f"no such clause: {', '.join(sorted(unknown))}")
    return {k: v for k, v in predicate.items() if v is not None}


def all_of(clauses: list[Column]) -> Column:
    out = F.lit(True)
    for c in clauses:
        out = out & c
    return out


def object_condition(predicate: dict) -> Column:
    p, out = checked(predicate), []
    for clause, column in (("class_names", "class_name"), ("l1", "l1"), ("states", "state"), ("sources", "source")):
        if clause in p:
            out.append(F.col(column).isin(list(p[clause])))
    if "min_conf" in p:
        out.append(F.col("conf") >= p["min_conf"])
    if "max_conf" in p:
        out.append(F.col("conf") <= p["max_conf"])
    if "object_tags" in p:
        out.append(F.arrays_overlap("tags", F.array(*map(F.lit, p["object_tags"]))))
    return all_of(out)


def frame_condition(predicate: dict) -> Column:
    p = checked(predicate)
    out = [F.col(f"scene.{axis}").isin(list(p[axis])) for axis in SCENE_AXES if axis in p]
    for clause, column in (("frame_ids", "frame_id"), ("session_ids", "session_id"), ("cities", "city")):
        if clause in p:
            out.append(F.col(column).isin(list(p[clause])))
    if "frame_tags" in p:
        out.append(F.arrays_overlap("tags", F.array(*map(F.lit, p["frame_tags"]))))
    return all_of(out)


def with_city(frames: DataFrame, sessions: DataFrame, predicate: dict) -> DataFrame:
    """Frames, joined with their session only where a clause needs it."""
    return frames.join(sessions.select("session_id", "city"), "session_id") if "cities" in predicate else frames


def select_objects(objects: DataFrame, frames: DataFrame, sessions: DataFrame, predicate: dict) -> DataFrame:
    found = objects.where(object_condition(predicate))
    if not FRAME_CLAUSES & checked(predicate).keys():
        return found
    return found.join(with_city(frames, sessions, predicate).where(frame_condition(predicate)), "frame_id")


def select_frames(objects: DataFrame, frames: DataFrame, sessions: DataFrame, predicate: dict) -> DataFrame:
    """Frames that satisfy the frame clauses and have one object that satisfies all object clauses."""
    found = with_city(frames, sessions, predicate).where(frame_condition(predicate))
    if OBJECT_CLAUSES & checked(predicate).keys():
        found = found.join(objects.where(object_condition(predicate)), "frame_id", "left_semi")
    return found


def match_records(records: DataFrame, predicate: dict) -> DataFrame:
    """The set reading: each clause may be met by another object. Records hold scene, city, classes, states, max_conf."""
    p = checked(predicate)
    out = [F.col(f"scene.{axis}").isin(list(p[axis])) for axis in SCENE_AXES if axis in p]
    if "cities" in p:
        out.append(F.col("city").isin(list(p["cities"])))
    for clause, column in (("class_names", "classes"), ("states", "states")):
        if clause in p:
            out.append(F.arrays_overlap(column, F.array(*map(F.lit, p[clause]))))
    if "min_conf" in p:
        out.append(F.coalesce("max_conf", F.lit(0.0)) >= p["min_conf"])
    return records.where(all_of(out))


def compile_terms(query: str, vocabulary: dict[str, tuple[str, list]]) -> tuple[dict, list[str]]:
    """`night AND vru, reviewed` to a predicate and the terms understood.

    `vocabulary` maps a term to (clause, values). Terms of one clause widen it, others narrow. An empty query and an
    unknown term are errors.
    """
    parts = [re.sub(r"\s+", "_", t.strip().lower()) for t in re.split(r"\s+AND\s+|,", query) if t.strip()]
    if not parts:
        raise ValueError("the query is empty")
    predicate: dict[str, list] = {}
    for term in parts:
        if term not in vocabulary:
            raise ValueError(f"unknown term: {term}")
        clause, values = vocabulary[term]
        predicate[clause] = list(dict.fromkeys([*predicate.get(clause, []), *values]))
    return predicate, parts
