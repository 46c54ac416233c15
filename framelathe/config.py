"""Source manifest and quality gates, from YAML.

Names of fields are the keys of those files, and defaults those of a missing key: fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class SchemaGates:
    detect_codebase_version: bool = True
    required_features: tuple[str, ...] = ()
    require_at_least_one_image: bool = True
    image_keys_any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class SignalGates:
    calibrate_from: str | None = None
    anomaly_percentile: float = 99.9
    max_anomalous_frame_ratio: float = 0.01
    max_missing_frame_ratio: float = 0.02


@dataclass(frozen=True)
class QualityGates:
    schema: SchemaGates = SchemaGates()
    signal: SignalGates = SignalGates()
    require_language_instruction: bool = True
    on_fail: str = "quarantine"

    def __post_init__(self):
        if self.on_fail not in ("quarantine", "drop"):
            raise ValueError(f"on_fail is 'quarantine' or 'drop', not {self.on_fail!r}")


@dataclass(frozen=True)
class Source:
    id: str
    role: str = "dev"
    hf_repo: str | None = None
    codebase_version: str | None = None
    max_episodes: int | None = None
    license: str | None = None
    license_mirror_stated: str | None = None
    revision: str | None = None
    enabled: bool = True


@dataclass(frozen=True)
class Sources:
    storage_budget_gb: float = 25.0
    data_root: str = "./data"
    sources: tuple[Source, ...] = field(default_factory=tuple)

    def get(self, source_id: str) -> Source:
        for s in self.sources:
            if s.id == source_id:
                return s
        raise KeyError(f"unknown source {source_id!r}; known: {[s.id for s in self.sources]}")

    def enabled(self) -> list[Source]:
        return [s for s in self.sources if s.enabled]


def _yaml(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_gates(path: str | Path) -> QualityGates:
    raw = _yaml(path)
    part = lambda k: raw.get(k) or {}
    schema, signal = part("schema"), part("signal")
    return QualityGates(
        schema=SchemaGates(
            schema.get("detect_codebase_version", True),
            tuple(schema.get("required_features") or ()),
            schema.get("require_at_least_one_image", True),
            tuple(schema.get("image_keys_any_of") or ()),
        ),
        signal=SignalGates(
            signal.get("calibrate_from"),
            float(signal.get("anomaly_percentile", 99.9)),
            float(signal.get("max_anomalous_frame_ratio", 0.01)),
            float(signal.get("max_missing_frame_ratio", 0.02)),
        ),
        require_language_instruction=part("annotation").get("require_language_instruction", True),
        on_fail=part("policy").get("on_fail", "quarantine"),
    )


def load_sources(path: str | Path) -> Sources:
    raw = _yaml(path)
    return Sources(
        float(raw.get("storage_budget_gb", 25.0)), raw.get("data_root", "./data"), tuple(Source(**s) for s in raw.get("sources") or ())
    )


def load_env(path: str | Path = ".env") -> dict[str, str]:
    """Set variables of a ``.env`` file that are not set yet; returns those it set."""
    import os

    out = {}
    path = Path(path)
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            v = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
            if k and k not in os.environ:
                os.environ[k] = out[k] = v
    return out
