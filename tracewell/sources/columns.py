"""Decoded events to Arrow columns.

Decoders give an event as a dictionary: its columns by name, and its property bags as attributes and resource. A batch of events is laid out
column by column: property maps as flat arrays with offsets, never as a dictionary per property.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa

from tracewell.functions.values import LEAF, display, flat_rows, flatten, leaves, to_json


def _scalars_of(bag: dict) -> list[tuple[str, str]]:
    """(path, text) of every scalar that isn't null, in document order."""
    return [(p, display(v)) for p, v in leaves(bag) if v is not None]


def as_row(attributes: dict, resource: dict, **columns: Any) -> dict:
    """One event as a row of its table."""
    return {
        **columns, "attributes_json": to_json(attributes), "resource_json": to_json(resource), "attr": flatten(attributes), "res": flatten(resource),
        "leaf_list": [{"path": p, "text": t} for p, t in _scalars_of(attributes)],
    }


def _properties(bags: list[dict], kind: pa.MapType) -> pa.MapArray:
    """The flattened bags as a map column."""
    ends, paths, kinds, texts, leaf_ends, found = [0], [], [], [], [0], []
    known: dict[int, tuple] = {}
    for bag in bags:
        # the events of a request share their resource
        rows = known.get(id(bag))
        if rows is None:
            rows = known[id(bag)] = tuple(flat_rows(bag))
        for path, k, text, some in rows:
            paths.append(path)
            kinds.append(k)
            texts.append(text)
            found += some
            leaf_ends.append(len(found))
        ends.append(len(paths))
    leaf = kind.item_type.field("leaves").type.value_type
    cols = list(zip(*found, strict=True)) if found else [()] * len(LEAF)
    leaves_ = pa.StructArray.from_arrays([pa.array(c, leaf.field(n).type) for c, n in zip(cols, LEAF, strict=True)], fields=list(leaf))
    item = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(leaf_ends, pa.int32()), leaves_, type=kind.item_type.field("leaves").type)], fields=list(kind.item_type))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(paths, pa.string()), item, type=kind)


def _leaf_lists(bags: list[dict], kind: pa.ListType) -> pa.ListArray:
    ends, paths, texts = [0], [], []
    for bag in bags:
        for path, text in _scalars_of(bag):
            paths.append(path)
            texts.append(text)
        ends.append(len(paths))
    item = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), item, type=kind)


def record_batch(events: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The events as a batch of their table's columns."""
    attributes, resources = [e["attributes"] for e in events], [e["resource"] for e in events]
    texts: dict[int, str] = {}

    def json_of(bag: dict) -> str:
        if id(bag) not in texts:
            texts[id(bag)] = to_json(bag)
        return texts[id(bag)]

    made = {
        "attributes_json": lambda t: pa.array(map(to_json, attributes), t), "resource_json": lambda t: pa.array(map(json_of, resources), t),
        "attr": lambda t: _properties(attributes, t), "res": lambda t: _properties(resources, t), "leaf_list": lambda t: _leaf_lists(attributes, t),
    }
    return pa.RecordBatch.from_arrays([made[f.name](f.type) if f.name in made else pa.array([e.get(f.name) for e in events], f.type) for f in schema], schema=schema)
