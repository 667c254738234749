"""Parameters of retrieval as a typed record, from JSON or 'k=v,...' text."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

METRICS, KEY_TYPES = ("l2", "dot"), ("last_ffn_input", "last_ffn_output")


@dataclass(frozen=True)
class Retrieval:
    k: int = 1024
    weight: float = 0.25
    temperature: float = 1.0
    metric: str = "l2"
    key_type: str = "last_ffn_input"  # a label of the datastore; nothing is computed from it
    nprobe: int = 32
    cells: int = 4096
    parts: int = 64
    min_knns: int = 1
    max_knns: int = 1024
    no_pointer: bool = False
    block: int = 1024
    stride: int = 512
    batch_rows: int = 1000

    def __post_init__(self):
        for name, known in (("metric", METRICS), ("key_type", KEY_TYPES)):
            value = str(getattr(self, name)).lower()
            if value not in known:
                raise ValueError(f"{name} {value!r} is none of {known}")
            object.__setattr__(self, name, value)
        if not 0 <= self.weight <= 1:
            raise ValueError("weight must be within 0 and 1")

    @classmethod
    def from_json(cls, path: str) -> Retrieval:
        with open(path) as f:
            return cls(**json.load(f))

    @classmethod
    def from_text(cls, text: str) -> Retrieval:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        out = {}
        for part in filter(None, text.split(",")):
            k, _, v = part.partition("=")
            if k not in kinds:
                raise ValueError(f"unknown parameter {k!r}")
            out[k] = v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v)
        return cls(**out)

    def as_dict(self) -> dict:
        return asdict(self)
