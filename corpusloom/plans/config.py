"""Typed configuration: files that build on others, strict keys and types, dotted overrides, checks across sections."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Text:
    min_duration: float = 1.0
    max_duration: float = 20.0
    max_chars: int = 320
    max_words: int = 72
    strip_marks: bool = True
    lower: bool = True
    fold_alef: bool = False
    digits: bool = True


@dataclass(frozen=True)
class Align:
    min_word: float = 0.04
    max_word: float = 2.5
    min_score: float = -6.5


@dataclass(frozen=True)
class Discovery:
    min_word_freq: int = 5
    min_pattern_count: int = 3
    min_pattern_frac: float = 0.08
    max_codes: int = 4
    max_raw_patterns: int = 4
    min_context_agreement: float = 0.75
    n_bootstrap: int = 24
    bootstrap_frac: float = 0.8
    min_stability: float = 0.72
    min_silhouette: float = 0.10
    min_separation: float = 0.55
    max_duration_confound: float = 0.25
    pca_dim: int = 48
    min_cluster_frac: float = 0.12
    cap: int = 600
    seed: int = 1234


@dataclass(frozen=True)
class Batching:
    boundaries: list[int] = field(default_factory=lambda: [32, 64, 96, 128, 160, 200, 240])
    batch: int = 32
    drop_last: bool = False


@dataclass(frozen=True)
class Inference:
    top_k: int = 50
    top_p: float = 0.95
    temperature: float = 0.7
    tau_low: float = 0.15
    tau_high: float = 0.45
    exits: list[int] = field(default_factory=lambda: [3, 5, 8])
    repetition_window: int = 12
    repetition_max_repeats: int = 3
    force_depth: int | None = None


@dataclass(frozen=True)
class Config:
    name: str = "corpus"
    text: Text = field(default_factory=Text)
    align: Align = field(default_factory=Align)
    discovery: Discovery = field(default_factory=Discovery)
    batching: Batching = field(default_factory=Batching)
    inference: Inference = field(default_factory=Inference)

    def validate(self) -> Config:
        i, d = self.inference, self.discovery
        checks = {
            "0 <= tau_low <= tau_high <= 1": 0 <= i.tau_low <= i.tau_high <= 1,
            "exits must rise": i.exits == sorted(set(i.exits)) and len(i.exits) > 0,
            "min_cluster_frac must lie in (0, 0.5)": 0 < d.min_cluster_frac < 0.5,
            "min_duration <= max_duration": self.text.min_duration <= self.text.max_duration,
            "boundaries must rise": self.batching.boundaries == sorted(set(self.batching.boundaries)),
            "force_depth must be an exit": i.force_depth is None or i.force_depth in i.exits,
        }
        failed = [k for k, ok in checks.items() if not ok]
        if failed:
            raise ValueError("; ".join(failed))
        return self


def merged(base: dict, top: dict) -> dict:
    out = dict(base)
    for k, v in top.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_tree(path: str | Path, above: tuple[Path, ...] = ()) -> dict:
    """A JSON or YAML mapping laid over those that its _base_ names; relative names start from the file's folder."""
    path = Path(path).resolve()
    if path in above:
        raise ValueError(f"{path} builds on itself")
    raw = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        tree = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need the yaml package; JSON files don't") from e
        tree = yaml.safe_load(raw) or {}
    if not isinstance(tree, dict):
        raise ValueError(f"{path} is no mapping")
    bases = tree.pop("_base_", [])
    out: dict = {}
    for b in [bases] if isinstance(bases, str) else bases:
        out = merged(out, read_tree(path.parent / b, (*above, path)))
    return merged(out, tree)


def _value(value: Any, kind: Any, at: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None else _value(value, next(a for a in args if a is not type(None)), at)
    if dataclasses.is_dataclass(kind):
        return _build(kind, value, at)
    if origin is list and isinstance(value, (list, tuple)):
        return [_value(v, args[0], f"{at}[{i}]") for i, v in enumerate(value)]
    if kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if kind is int and not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer()):
        return int(value)
    if isinstance(kind, type) and isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool):
        return value
    raise TypeError(f"{at}: {value!r} is no {getattr(kind, '__name__', kind)}")


def _build(kind: type, tree: Any, at: str = "") -> Any:
    if not isinstance(tree, dict):
        raise TypeError(f"{at or 'config'} must be a mapping")
    hints = typing.get_type_hints(kind)
    if unknown := sorted(set(tree) - set(hints)):
        raise KeyError(f"unknown keys in {at or 'config'}: {', '.join(unknown)}")
    return kind(**{k: _value(v, hints[k], f"{at}.{k}".lstrip(".")) for k, v in tree.items()})


def load(path: str | Path | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """Defaults, then the file, then overrides such as {"text.max_chars": 400}; checked."""
    tree = read_tree(path) if path else {}
    for dotted, value in (overrides or {}).items():
        top: Any = value
        for key in reversed(dotted.split(".")):
            top = {key: top}
        tree = merged(tree, top)
    return _build(Config, tree).validate()


def save(config: Config, path: str | Path) -> None:
    Path(path).write_text(json.dumps(dataclasses.asdict(config), ensure_ascii=False, indent=1), encoding="utf-8")
