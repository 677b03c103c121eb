"""Experiment parameters: one frozen dataclass instead of a config tree."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# Fixed values that must equal the reference's defaults (main experiment):
# labels of the five target bins, lowest to highest.
DEFAULT_LABELS = ("very bad", "bad", "neutral", "good", "very good")
# Bar metrics in canonical (lower-case) form.
BAR_METRICS = ("open", "high", "low", "close", "adj_close", "volume")


@dataclass(frozen=True)
class Frame:
    split: str
    start: dt.date
    end: dt.date


def frames(*triples) -> tuple[Frame, ...]:
    out = []
    for split, start, end in triples:
        if isinstance(start, str):
            start = dt.date.fromisoformat(start)
        if isinstance(end, str):
            end = dt.date.fromisoformat(end)
        out.append(Frame(split, start, end))
    return tuple(out)


@dataclass(frozen=True)
class Params:
    frames: tuple[Frame, ...]
    tickers: tuple[str, ...] | None = None       # None = every ticker in the bars
    keywords: tuple[str, ...] = ()
    keywords_literal: bool = False                # False: keywords are regexes
    lookback: int = 5
    horizon: int = 1
    buying_at: str = "open"
    selling_at: str = "open"
    aggregation: str = "last"                     # first|last|mean|max|min
    numerical_features: tuple[str, ...] = BAR_METRICS
    textual_features: tuple[str, ...] = ("title", "weekday", "ticker")
    drop_features_for_last_day: tuple[str, ...] = (
        "close", "adj_close", "high", "low", "volume")
    relative_to: str = "first"                    # first|last|min|max|mean
    num_bins: int = 5
    labels: tuple[str, ...] = DEFAULT_LABELS
    strategy: str = "equal_frequency"             # or equal_width
    max_titles_per_day: int = 2
    min_titles_per_window: int = 5
    replicas: int = 2
    trading_on_weekend: bool = False              # carry weekday bars over weekends first
    null_target_limit: float = 0.05
    seed: int = 0
    train_split: str = "train"

    @property
    def window(self) -> int:
        return self.lookback + self.horizon

    def frame(self, split: str) -> Frame:
        for f in self.frames:
            if f.split == split:
                return f
        raise KeyError(split)
