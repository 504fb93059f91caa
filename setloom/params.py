"""Job parameters. Defaults follow the values documented in SURVEY Appendix B."""

from __future__ import annotations

from dataclasses import dataclass

# Smallest positive normal double; p values are floored here before a logarithm.
DOUBLE_MIN = 2.2250738585072014e-308


@dataclass(frozen=True)
class Contrast:
    factor: str
    numerator: str
    denominator: str


@dataclass(frozen=True)
class LinkSettings:
    """Thresholds and caps of the linking run. A cap of 0 means "no cap"."""

    gsea_top_n: int = 0
    gsea_q_threshold: float = 0.05
    gsea_min_per_direction: int = 1
    helper_q_threshold: float | None = None
    helper_nes_threshold: float | None = None
    helper_max_per_direction: int = 50
    helper_claims_per_theme: int = 0
    theme_cap: int = 10
    theme_top_pathways: int = 3
    theme_leading_edge_target: int = 12
    theme_cap_total: int = 20
    linker_theme_cap: int = 10
    linker_theme_cap_total: int = 20
    themes_per_batch: int = 2
    claims_per_batch: int = 3
    theme_only_cap_with_helpers: int = 1
    theme_only_cap_no_helpers: int = 3
    coverage_cap: int = 3
    thesis_helper_themes: int = 3
    thesis_theme_cap: int = 0

    @property
    def max_genes(self) -> int:
        return min(15, max(10, self.theme_leading_edge_target))


@dataclass(frozen=True)
class SupportThresholds:
    support_q: float = 0.05
    support_effect: float = 0.30
    partial_q: float = 0.10
    partial_effect: float = 0.20
