"""Configuration of the ranking pipeline: validated, read from and written to YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

import yaml

from siktverk.operators.features import FEATURES


def _equal() -> dict[str, float]:
    return {f: 100 / len(FEATURES) for f in FEATURES}


@dataclass
class HardFilter:
    expected_lid: str | None = "swe_Latn"
    minimum: dict[str, float] = field(default_factory=dict)
    require_pii_absence: bool | None = None

    def __post_init__(self) -> None:
        if unknown := set(self.minimum) - set(FEATURES):
            raise ValueError(f"no such feature: {sorted(unknown)}")


@dataclass
class Priority:
    """Credits over the seven features; they are not negative and sum to 100."""

    credits: dict[str, float] = field(default_factory=_equal)
    mu: float | None = None

    def __post_init__(self) -> None:
        if set(self.credits) != set(FEATURES):
            raise ValueError("credits must name every feature once")
        if min(self.credits.values()) < 0 or abs(sum(self.credits.values()) - 100) > 1e-6:
            raise ValueError("credits must not be negative and must sum to 100")

    def unit(self) -> dict[str, float]:
        return {f: self.credits[f] / 100 for f in FEATURES}


@dataclass
class Ranking:
    k: int = 100
    m: float = 10
    l2_mode: str = "prototype"
    output_format: str = "parquet"
    output_path: str = "ranking.parquet"
    include_filtered_rows: bool = True

    def __post_init__(self) -> None:
        if self.k <= 0 or self.m < 1:
            raise ValueError("k must be positive and m at least 1")
        if self.l2_mode not in ("prototype", "trained", "disabled"):
            raise ValueError(f"no such l2_mode: {self.l2_mode}")
        if self.output_format not in ("parquet", "ndjson"):
            raise ValueError(f"no such output_format: {self.output_format}")


@dataclass
class Training:
    # The default grids and sizes of training and evaluation.
    alphas: tuple[float, ...] = (1e-4, 1e-2, 1.0, 100.0, 1e4)
    gammas: tuple[float, ...] = (0.0, 1.0, 2.0, 5.0, 10.0)
    learning_rate: float = 0.05
    epochs: int = 250
    max_pairs: int = 250_000
    percentiles: tuple[float, ...] = (1, 5, 10, 20, 30)
    relevance_bins: int = 8
    eval_k: tuple[int, ...] = (10, 25, 50, 100)
    group_size: int = 64
    groups_per_bucket: int = 32

    def __post_init__(self) -> None:
        if self.relevance_bins < 2:
            raise ValueError("relevance_bins must be at least 2")


@dataclass
class Pipeline:
    hard_filter: HardFilter = field(default_factory=HardFilter)
    priority: Priority = field(default_factory=Priority)
    ranking: Ranking = field(default_factory=Ranking)
    training: Training = field(default_factory=Training)
    annotations: str | None = None
    metadata: str | None = None
    l1_model: str | None = None
    l2_model: str | None = None


# Providers of model judges, with the address of those that speak another's protocol and the variable that holds the key.
PROVIDERS: dict[str, tuple[str | None, str, bool]] = {
    "anthropic": (None, "ANTHROPIC_API_KEY", False),
    "openai": (None, "OPENAI_API_KEY", True),
    "berget": ("https://api.berget.ai/v1", "BERGET_API_KEY", True),
}


@dataclass(frozen=True)
class Judge:
    """How a model judge is reached. Calls are made by a function that the caller passes in; keys are read by it, and never kept here."""

    provider: str
    model: str
    max_tokens: int = 256
    temperature: float = 0.0
    base_url: str | None = None
    api_key_env: str | None = None
    openai_compatible: bool = True

    @staticmethod
    def resolve(provider: str, model: str, max_tokens: int = 256, temperature: float = 0.0, base_url: str | None = None, api_key_env: str | None = None) -> Judge:
        """With what the provider has by default; raises for an unknown one."""
        if provider not in PROVIDERS:
            raise ValueError(f"no such provider: {provider}; there are {sorted(PROVIDERS)}")
        url, key, compatible = PROVIDERS[provider]
        return Judge(provider, model, max_tokens, temperature, url if base_url is None else base_url, api_key_env or key, compatible)


@dataclass
class Gold:
    """A run of the judged sample; ``max_chars`` below 0 sends whole texts."""

    annotations: str
    output: str
    prompt: str
    corpus: str | None = None
    size: int = 2000
    seed: int = 42
    language: str = "swe_Latn"
    mode: str = "uniform"
    pool_size: int = 100_000
    provider: str = "openai"
    model: str = ""
    batch_size: int = 5
    checkpoint_every: int = 1000
    max_chars: int = 3000
    max_scan: int | None = None
    max_budget: float | None = None
    price_in: float = 0.27
    price_out: float = 0.54
    estimate_only: bool = False
    skip_text_fetch: bool = False
    skip_scoring: bool = False


def load_config(path: str | Path) -> Pipeline:
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    parts = {"hard_filter": HardFilter, "priority": Priority, "ranking": Ranking, "training": Training}
    return Pipeline(**{k: parts[k](**v) if k in parts else v for k, v in raw.items()})


def save_config(config: Pipeline, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    plain = asdict(config)
    plain["training"] = {k: list(v) if isinstance(v, tuple) else v for k, v in plain["training"].items()}
    Path(path).write_text(yaml.safe_dump(plain, sort_keys=True), encoding="utf-8")
