"""Settings of a run."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """The settings that bear on text; extractors bring their own."""

    images_dir: str = "./photos"
    image_files: tuple[str, ...] | None = None
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")
    rename_prefix: str = "page"
    extraction_method: str = "paddleocrvl"
    pdf_dpi: int = 200
    pdf_force_ocr: bool = False
    output_file: str = "./output/book.md"
    figures_dir: str = "./output/figures"
    report_file: str = "output/ocr_report.md"
    log_file: str = "output/ocr_run.log"
    resume: bool = True
    postprocess: bool = True
    keep_html: bool = False
    mode: str = "base"
    vault_root: str | None = None
    vault_path: str = "Documents/OCR"
    vault_figures_dir: str = "Files/OCR"
    remove_isolated_page_numbers: bool = True
    rejoin_hyphenated_words: bool = True
    collapse_blank_lines: bool = True
    header_patterns: tuple[tuple[str, int], ...] = ()
    use_layout_detection: bool = True
    n_parallel: int = 1
    page_timeout: int = 120
    verbose: bool = False

    def __post_init__(self):
        if self.n_parallel < 1:
            raise ValueError("n_parallel must be 1 or more")
        if self.mode not in ("base", "obsidian"):
            raise ValueError(f"unknown mode: {self.mode}")
        if self.extraction_method not in ("paddleocrvl", "text", "docling"):
            raise ValueError(f"unknown method: {self.extraction_method}")


#: Settings that the environment can give, by field.
VARIABLES = {"vault_root": "OCR_OBSIDIAN_VAULT_ROOT", "vault_path": "OCR_OBSIDIAN_VAULT_PATH", "vault_figures_dir": "OCR_OBSIDIAN_VAULT_FIGURES_DIR", "n_parallel": "OCR_N_PARALLEL", "page_timeout": "OCR_PAGE_TIMEOUT"}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def parse_bool(value: str | None) -> bool | None:
    """None where nothing is set."""
    if value is None or not value.strip():
        return None
    low = value.strip().lower()
    if low not in TRUE + FALSE:
        raise ValueError(f"not a yes or no: {value}")
    return low in TRUE


def parse_int(value: str | None, default: int | None = None) -> int | None:
    return default if value is None or not value.strip() else int(value)


def from_environment(variables: Mapping[str, str] | None = None) -> dict:
    """Settings that the environment gives, by field; those that are blank stay out."""
    variables = os.environ if variables is None else variables
    found = {}
    for field, name in VARIABLES.items():
        value = variables.get(name, "")
        if value.strip():
            found[field] = int(value) if field in ("n_parallel", "page_timeout") else value
    return found
