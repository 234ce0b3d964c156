"""Typed settings from the environment, prefix DRILLMILL_; unknown names are ignored."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "DRILLMILL_"


@dataclass(frozen=True)
class Settings:
    input_folder: str = "data/sample"
    output_csv: str = "outputs/extracted_forms.csv"
    tesseract_cmd: str = ""
    vlm_model: str = "mock"
    vlm_backend: str = "mock"
    hf_vlm_model: str = ""
    hf_provider: str = "auto"
    hf_token: str = ""
    hf_max_image_pixels: int = 1_000_000
    prompt_file: str = ""
    pdf_render_dpi: int = 600
    preprocess_enabled: bool = True
    preprocess_debug_images: bool = False
    preprocess_outdir: str = "runs/preprocessed"
    enable_osd_orientation: bool = True
    use_clahe: bool = True
    do_deskew: bool = True
    checkbox_enabled: bool = True
    checkbox_debug: bool = False
    checkbox_outdir: str = "runs/checkbox"
    temperature: float = 0.0
    max_new_tokens: int = 512
    failure_scope: str = "form"

    def with_overrides(self, **changes: object) -> Settings:
        return replace(self, **changes)


def _cast(kind: str, text: str) -> object:
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes", "on", "t", "y")
    return int(text) if kind == "int" else float(text) if kind == "float" else text


def load_settings(env: dict[str, str] | None = None, env_file: str | None = None) -> Settings:
    """The environment wins over the file."""
    found: dict[str, str] = {}
    if env_file and Path(env_file).exists():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                found[name.strip().upper()] = value.strip().strip("'\"")
    found |= {k.upper(): v for k, v in (os.environ if env is None else env).items()}
    return Settings(**{f.name: _cast(str(f.type), found[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in found})


def setup_logging(verbose: bool = False) -> None:
    """Once; a second call changes only the level."""
    root = logging.getLogger("drillmill")
    if not root.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(handler)
    root.setLevel(logging.DEBUG if verbose else logging.INFO)
