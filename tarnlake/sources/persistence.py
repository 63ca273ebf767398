"""Models as JSON: an envelope with a type, numbers that JSON lacks under tags, numpy arrays as lists."""

from __future__ import annotations

import dataclasses
import datetime
import json
import math

import numpy as np

VERSION = "0.7.0"


def serialize_value(v):
    if isinstance(v, np.ndarray):
        return {"__type__": "array", "value": serialize_value(v.tolist())}
    if isinstance(v, np.generic):
        return serialize_value(v.item())
    if isinstance(v, float) and not math.isfinite(v):
        return {"__type__": "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"}
    if isinstance(v, dict):
        return {str(k): serialize_value(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [serialize_value(x) for x in v]
    return v


def deserialize_value(v):
    if isinstance(v, dict):
        kind = v.get("__type__")
        if kind == "array":
            return np.array(deserialize_value(v["value"]))
        if kind in ("NaN", "Infinity", "-Infinity"):
            return float(kind.replace("Infinity", "inf"))
        return {k: deserialize_value(x) for k, x in v.items()}
    return [deserialize_value(x) for x in v] if isinstance(v, list) else v


def detect_model_type(model) -> str:
    return model.get("type", "unknown") if isinstance(model, dict) else type(model).__name__


def _state(model) -> dict:
    if callable(getattr(model, "to_json", None)):
        return model.to_json()
    if dataclasses.is_dataclass(model):
        return {f.name: getattr(model, f.name) for f in dataclasses.fields(model)}
    return model if isinstance(model, dict) else dict(vars(model))


def save_model(model) -> str:
    return json.dumps({"__tarnlake__": True, "version": VERSION, "timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "type": detect_model_type(model), "data": serialize_value(_state(model))})


def load_model(text: str, kinds: dict[str, type] | None = None):
    """The state, or an object of the named kind."""
    d = json.loads(text)
    data = deserialize_value(d["data"] if isinstance(d, dict) and d.get("__tarnlake__") else d)
    kind = (kinds or {}).get(d.get("type")) if isinstance(d, dict) else None
    if kind is None:
        return data
    if dataclasses.is_dataclass(kind):
        return kind(**data)
    model = kind.__new__(kind)
    vars(model).update(data)
    return model


class Saveable:
    """Adds save() and load()."""

    def save(self) -> str:
        return save_model(self)

    @classmethod
    def load(cls, text: str):
        return load_model(text, {cls.__name__: cls})


def make_saveable(kind: type) -> type:
    """kind with save() and load()."""
    return type(kind.__name__, (kind, Saveable), {})


def add_serialization_support(kind: type, to_json) -> type:
    kind.to_json = to_json
    return kind
