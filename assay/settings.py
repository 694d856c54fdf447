"""Knobs shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


# Work sizes, thresholds and weights that decide results.
@dataclass(frozen=True)
class Settings:
    cv_splits: int = 5
    random_state: int = 42
    outlier_contamination: float = 0.05
    bootstrap_iterations: int = 50
    forest_trees: int = 200
    # Values (rows x features) that one task grows a subtree from.
    forest_task_cells: int = 4 << 20
    permutation_repeats: int = 8
    confidence_weights: tuple[float, float, float] = (0.3, 0.4, 0.3)
    # None scores every row of a clustering; a number draws so many by hash.
    silhouette_rows: int | None = None
    # None trains on every row; a number switches on the hash sample.
    max_modeling_rows: int | None = None
    # Columns with up to this many distinct values take their quantiles from a
    # value-count table; beyond it the quantile is narrowed down pass by pass.
    direct_quantile_values: int = 1_000_000
    keyword_mode: str = "token"


DEFAULTS = Settings()
