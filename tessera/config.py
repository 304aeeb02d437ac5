"""Settings of the engine, as plain dictionaries that a YAML file can override."""

from __future__ import annotations

import copy
import hashlib
import json

DEFAULTS: dict = {
    "features": {"momentum_windows": [21, 63, 126, 252], "skip_recent": 21, "volatility_windows": [20, 60], "drawdown_window": 126, "volume_window": 60, "ma_windows": [50, 200], "rsi_window": 14, "band_window": 20, "band_width": 2.0},
    "preprocessing": {"limit": 3.0, "tail": 0.01},
    "labels": {"upper": 2.0, "lower": 2.0, "bars": 43, "span": 50, "discard_vertical": False, "min_return": 0.0},
    "validation": {"groups": 10, "test_groups": 2, "embargo_days": 5, "folds": 5},
    "bets": {"min_probability": 0.49, "cap": 0.05, "method": "half_kelly"},
    "neutralization": {"enabled": True, "exposures": ["sector", "size", "beta"], "proportion": 1.0},
    "portfolio": {"leg": "top_decile", "short_leg": "bottom_decile", "weighting": "conviction", "max_name": 0.05, "max_sector": 0.30, "long_only": True},
    "execution": {"stagger_days": 5, "cost_bps": 7.5},
    "reporting": {"bull": 0.10, "bear": -0.10, "window": 126},
}


def load_config(path: str | None = None) -> dict:
    """The defaults, overridden by a YAML file where one is given."""
    out = copy.deepcopy(DEFAULTS)
    if path:
        import yaml

        with open(path) as f:
            _merge(out, yaml.safe_load(f) or {})
    return out


def _merge(into: dict, other: dict) -> None:
    for k, v in other.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v


def fingerprint(cfg: dict) -> str:
    """Names what a set of settings makes, so results of other settings are never reused."""
    return hashlib.md5(json.dumps(cfg, sort_keys=True).encode()).hexdigest()[:12]
