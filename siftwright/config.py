"""Settings of the three phases. The configuration file's keys and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class CleaningConfig:
    normalize_unicode: bool = True
    remove_control_chars: bool = True
    remove_zero_width: bool = True
    collapse_whitespace: bool = True
    strip_text: bool = True
    lowercase: bool = False

    @property
    def complete(self) -> bool:
        """All steps but lower-casing are on."""
        return all((self.normalize_unicode, self.remove_control_chars, self.remove_zero_width, self.collapse_whitespace, self.strip_text))


@dataclass(frozen=True)
class AugmentConfig:
    enabled: bool = True
    synonym_replace_prob: float = 0.25
    token_noise_prob: float = 0.10
    max_augmentations_per_row: int = 1
    augment_minority_only: bool = True
    minority_threshold_ratio: float = 0.75


@dataclass(frozen=True)
class ParaphraseConfig:
    enabled: bool = True
    max_variants_per_row: int = 1
    apply_to_intents: tuple[int, ...] = (1, 2, 3, 4, 5, 6)


@dataclass(frozen=True)
class RunLogConfig:
    enabled: bool = True
    experiment: str = "data-engineering"


@dataclass(frozen=True)
class Phase1Config:
    dataset: str = "records"
    dataset_config: str = "multiclass"
    data_dir: str = "data"
    seed: int = 42
    cleaning: CleaningConfig = CleaningConfig()
    drop_invalid_rows: bool = True
    near_duplicate_threshold: float = 0.85
    near_duplicate_mode: str = "verified"


@dataclass(frozen=True)
class Phase2Config:
    data_dir: str = "data"
    seed: int = 42
    enabled: bool = True
    balancing_strategy: str = "oversample_median"
    augment: AugmentConfig = AugmentConfig()
    run_log: RunLogConfig = RunLogConfig()


@dataclass(frozen=True)
class Phase3Config:
    data_dir: str = "data"
    docs_dir: str = "docs"
    seed: int = 42
    enabled: bool = True
    leakage_near_threshold: float = 0.85
    leakage_sample_limit: int | None = 2000
    paraphrase: ParaphraseConfig = ParaphraseConfig()
    run_log: RunLogConfig = RunLogConfig()


@dataclass(frozen=True)
class Config:
    phase1: Phase1Config = field(default_factory=Phase1Config)
    phase2: Phase2Config = field(default_factory=Phase2Config)
    phase3: Phase3Config = field(default_factory=Phase3Config)


_text, _folder = str, lambda v: str(v).rstrip("/")

# The configuration file's keys. Settings and field; the sections that may hold the key, of which the first one
# that is there counts; the key; its type. What isn't in the file has the default of its dataclass.
KEYS = (
    ("phase1", "dataset", ("data",), "dataset", _text),
    ("phase1", "dataset_config", ("data",), "config", _text),
    ("phase1", "data_dir", ("data",), "data_dir", _folder),
    ("phase1", "seed", ("",), "seed", int),
    ("phase1", "drop_invalid_rows", ("data",), "drop_invalid_rows", bool),
    ("phase1", "near_duplicate_threshold", ("dedup",), "near_duplicate_threshold", float),
    ("phase1", "near_duplicate_mode", ("dedup",), "near_duplicate_mode", _text),
    ("phase1.cleaning", "lowercase", ("data",), "lowercase", bool),
    ("phase2", "data_dir", ("data",), "data_dir", _folder),
    ("phase2", "seed", ("",), "seed", int),
    ("phase2", "enabled", ("phase2",), "enabled", bool),
    ("phase2", "balancing_strategy", ("phase2",), "balancing_strategy", _text),
    ("phase2.augment", "enabled", ("phase2.augmentation",), "enabled", bool),
    ("phase2.augment", "synonym_replace_prob", ("phase2.augmentation",), "synonym_replace_prob", float),
    ("phase2.augment", "token_noise_prob", ("phase2.augmentation",), "token_noise_prob", float),
    ("phase2.augment", "max_augmentations_per_row", ("phase2.augmentation",), "max_augmentations_per_row", int),
    ("phase2.augment", "augment_minority_only", ("phase2.augmentation",), "minority_only", bool),
    ("phase2.run_log", "enabled", ("phase2.mlflow",), "enabled", bool),
    ("phase2.run_log", "experiment", ("phase2.mlflow",), "experiment_name", _text),
    ("phase3", "data_dir", ("data",), "data_dir", _folder),
    ("phase3", "docs_dir", ("phase3",), "docs_dir", _folder),
    ("phase3", "seed", ("",), "seed", int),
    ("phase3", "enabled", ("phase3",), "enabled", bool),
    ("phase3", "leakage_near_threshold", ("phase3",), "leakage_near_threshold", float),
    ("phase3", "leakage_sample_limit", ("phase3",), "leakage_sample_limit", lambda v: None if v is None else int(v)),
    ("phase3.paraphrase", "enabled", ("phase3.adversarial_paraphrase",), "enabled", bool),
    ("phase3.paraphrase", "max_variants_per_row", ("phase3.adversarial_paraphrase",), "max_variants_per_row", int),
    ("phase3.run_log", "enabled", ("phase3.mlflow", "phase2.mlflow"), "enabled", bool),
    ("phase3.run_log", "experiment", ("phase3.mlflow", "phase2.mlflow"), "experiment_name", _text),
)
MODES = ("verified", "lsh")


def _section(payload: dict[str, Any], path: str) -> dict[str, Any]:
    for key in filter(None, path.split(".")):
        payload = payload.get(key) or {}
    return payload


def _with(settings: Any, path: list[str], value: Any) -> Any:
    return replace(settings, **{path[0]: value if len(path) == 1 else _with(getattr(settings, path[0]), path[1:], value)})


def config_from(payload: dict[str, Any] | None) -> Config:
    """Nested settings to typed ones."""
    config = Config()
    for settings, name, sections, key, kind in KEYS:
        found = next(filter(None, (_section(payload or {}, s) for s in sections)), {})
        if key in found:
            config = _with(config, [*settings.split("."), name], kind(found[key]))
    if config.phase1.near_duplicate_mode not in MODES:
        raise ValueError(f"near_duplicate_mode is one of {MODES}")
    return config


def load_config(path: str | Path) -> Config:
    import yaml

    return config_from(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
