"""Settings of an index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexConfig:
    """page_strategy: `logical` (the page's own label) or `physical` (place in the file plus offset)."""

    page_strategy: str = "logical"
    page_offset: int = 0
    index_from_offset: bool = False
    capitalize: bool = False
    name_indexing: bool = True
    include_bold: bool = False
    surname_first: bool = True
    thin: int = 1
    dense: int = 20

    def __post_init__(self) -> None:
        if self.page_strategy not in ("logical", "physical"):
            raise ValueError(f"page_strategy: {self.page_strategy}")
        if not 1 <= self.thin <= 10 or not 5 <= self.dense <= 500:
            raise ValueError("thin is from 1 to 10, dense from 5 to 500")

    @property
    def start_page(self) -> int:
        """The first page, from 0, that is read."""
        return -self.page_offset if self.index_from_offset and self.page_offset < 0 else 0
