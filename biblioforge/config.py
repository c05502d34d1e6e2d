"""Settings of the matcher. The weights, bands and thresholds are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchConfig:
    doi: int = 15
    author: int = 7
    year_exact: int = 1
    year_adjacent: int = 0
    volume: int = 3
    page: int = 8
    title_exact: int = 14
    title_bands: tuple[tuple[int, int], ...] = ((95, 13), (90, 13), (85, 12), (80, 11), (75, 10))  # strictly above
    threshold: int = 26
    threshold_factor: float = 0.9
    min_year: int = 1700
    max_year: int = 2027  # a parameter, not the clock
    use_doi: bool = True  # DOI blocking; DOIs are scored in any case
    author_edge: str = "graph"  # "reference": DOI and volume strategies never see the author
    regex_mode: str = "quoted"  # "reference": title words are patterns as they are

    @property
    def accept(self) -> float:
        return self.threshold * self.threshold_factor

    @property
    def max_score(self) -> int:
        return self.doi + self.author + self.year_exact + self.volume + self.page + self.title_exact
