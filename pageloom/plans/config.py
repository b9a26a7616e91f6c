"""Settings of a run, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.scalar import IMAGE_TYPES

FORMATS = ("md", "epub")


# Names and defaults of the settings.
@dataclass(frozen=True)
class Config:
    input_dir: str
    output_dir: str
    book_title: str
    book_author: str = "Unknown"
    language: str = "en"
    sort_by_timestamp: bool = True
    supported_extensions: tuple[str, ...] = IMAGE_TYPES
    resize_target: int = 1150
    ocr_threads: int = 8
    add_page_markers: bool = True
    min_text_length: int = 50
    max_error_ratio: float = 0.15
    output_formats: tuple[str, ...] = FORMATS

    def __post_init__(self) -> None:
        wrong = {
            "book_title must not be blank": not (self.book_title or "").strip(),
            f"resize_target must be 0 or more, not {self.resize_target}": self.resize_target < 0,
            f"ocr_threads must be 1 or more, not {self.ocr_threads}": self.ocr_threads < 1,
            f"max_error_ratio must be over 0 and at most 1, not {self.max_error_ratio}": not 0 < self.max_error_ratio <= 1,
            f"min_text_length must be 0 or more, not {self.min_text_length}": self.min_text_length < 0,
            f"unknown output formats {sorted(set(self.output_formats) - set(FORMATS))}": bool(set(self.output_formats) - set(FORMATS)),
        }
        for said, holds in wrong.items():
            if holds:
                raise ValueError(said)

    @property
    def safe_name(self) -> str:
        kept = re.sub(r"[^\w \-]", "_", self.book_title)
        return kept.strip().replace(" ", "_")[:100]

    def path(self, name: str) -> str:
        """Where a part of the output goes."""
        below = {"ocr": "ocr_pages", "images": "processed_images", "markdown": f"{self.safe_name}.md", "epub": f"{self.safe_name}.epub", "report": "error_report.txt"}
        return f"{self.output_dir.rstrip('/')}/{below[name]}"
