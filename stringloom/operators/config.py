"""Settings of an index build."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
#: Property names of a configuration file and the fields they set.
PROPERTIES = {
    "alphabet.num": "alphabet",
    "div.start": "start_len",
    "div.step": "step",
    "root.max.count": "max_count",
    "budget.factor": "budget_factor",
    "lcp.range": "lcp_range",
    "fs.extra.len": "overlap",
    "sorting.method": "sorting",
    "grouping.method": "grouping",
    "spark.partitions": "n_partitions",
    "working.dir": "working_dir",
    "input.dir": "input_dir",
    "output.location": "output_location",
    "merged.filename": "merged_filename",
}


def size_of(text: str) -> int:
    """Bytes of `10m`, `1g`, `512`."""
    if not (m := re.fullmatch(r"\s*(\d+)\s*([kmgKMG]?)[bB]?\s*", text)):
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * UNITS[m[2].lower()]


@dataclass(frozen=True)
class IndexConfig:
    alphabet: int = 128
    start_len: int = 2
    step: int = 4
    max_count: int = 2_000_000
    budget_factor: float = 1.0
    lcp_range: int = 128
    overlap: int = 1024
    sorting: str = "java"
    grouping: str = "bfhg"
    n_partitions: int = 96
    working_dir: str = ""
    input_dir: str = ""
    output_location: str = ""
    merged_filename: str = ""

    @property
    def bucket_budget(self) -> int:
        return int(self.max_count * self.budget_factor)

    @classmethod
    def from_properties(cls, path: str, **overrides) -> IndexConfig:
        """Read key=value lines; unknown keys are ignored and `overrides` win."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        values = {}
        for line in Path(path).read_text().splitlines():
            key, sign, value = line.partition("=")
            if sign and not key.lstrip().startswith("#") and (name := PROPERTIES.get(key.strip())):
                kind = kinds[name]
                values[name] = size_of(value) if kind is int and value.strip()[-1:].lower() in "kmgb" else kind(float(value)) if kind is int else kind(value.strip())
        return replace(cls(), **values, **overrides)
