"""Settings of the engine, read from any mapping of strings (such as the environment)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

TRUE = frozenset("1 on true yes y t".split())
FALSE = frozenset(["", *"0 off false no n f".split()])


def truth(value: str) -> bool:
    v = value.strip().lower()
    if v in TRUE:
        return True
    if v in FALSE:
        return False
    raise ValueError(f"not a truth value: {value!r}")


def storage_url(value: str, https: bool = False) -> str | None:
    """With a scheme; null for a blank."""
    v = value.strip().rstrip("/")
    if not v:
        return None
    return v if urlsplit(v).scheme and "://" in v else f"{'https' if https else 'http'}://{v}"


@dataclass(frozen=True)
class Settings:
    """Where the tables lie, how vectors look and how many rows a request may ask for."""

    mode: str = "server"
    folder: str = "./vignette_data"
    url: str | None = None
    vector_size: int = 768
    int8: bool = True
    quantile: float = 0.99
    top_k: int = 10
    most_top_k: int = 25
    pool: int = 100
    most_pool: int = 300
    overfetch: int = 3
    graph_limit: int = 10

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "VIGNETTE_") -> Settings:
        """PREFIX_<PROFILE>_<NAME> comes before PREFIX_<NAME>, and that before the default; the profile is PREFIX_ENV,
        dev or prod."""
        profile = values.get(prefix + "ENV", "").strip().lower()

        def get(name: str, default: str) -> str:
            own = values.get(f"{prefix}{profile.upper()}_{name}") if profile in ("dev", "prod") else None
            return own if own is not None else values.get(prefix + name, default)

        mode = get("MODE", cls.mode).strip().lower()
        mode = "local" if mode == "memory" else mode
        made = cls(
            mode=mode,
            folder=get("FOLDER", cls.folder),
            url=storage_url(get("URL", ""), truth(get("HTTPS", "false"))),
            vector_size=int(get("VECTOR_SIZE", str(cls.vector_size))),
            int8=truth(get("INT8", "true")),
            quantile=float(get("QUANTILE", str(cls.quantile))),
            **{k: int(get(k.upper(), str(getattr(cls, k)))) for k in ("top_k", "most_top_k", "pool", "most_pool", "overfetch", "graph_limit")},
        )
        made.validate()
        return made

    def validate(self) -> None:
        if self.mode not in ("local", "server"):
            raise ValueError(f"mode must be local or server, got {self.mode!r}")
        if self.vector_size < 1:
            raise ValueError("vector_size must be positive")
        if not 0 < self.quantile <= 1:
            raise ValueError("quantile must be in (0, 1]")
        if not 1 <= self.top_k <= self.most_top_k or not 1 <= self.pool <= self.most_pool:
            raise ValueError("a default lies beyond its maximum")
