"""Readers and writers of a provider's wire format by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemark.sources import tables, wire


@dataclass(frozen=True)
class Format:
    """How a provider's documents become points, and points its objects or lines."""

    read: Callable
    write: Callable


FORMATS = {
    "results": Format(wire.read_results, wire.write_matrix),
    "vector": Format(wire.read_results, wire.write_vector),
    "influx": Format(wire.read_influx, wire.write_influx),
    "annotated": Format(tables.read_annotated, tables.write_annotated),
    "sql": Format(tables.read_names_and_types, tables.write_rows),
}


def of(name: str) -> Format:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name}")
    return FORMATS[name]
