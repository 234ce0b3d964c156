"""Ports for kernels that live outside Spark (rasterising, OCR, vision models) and their deterministic stand-ins.

A port is a class made once per partition, on the executor. Calls never raise: they return (value, error), so that a task
isn't retried for a bad page, and answers are stored before anything reads them, so that no page is asked about twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from drillmill.schema import json_schema, page_schema
from drillmill.settings import Settings


class VisionBackend(Protocol):
    def chat(self, *, prompt: str, images: list[bytes], json_schema: dict, temperature: float, max_tokens: int) -> str: ...


class Rasteriser(Protocol):
    def pages(self, name: str, content: bytes, dpi: int) -> list[tuple[bytes, int, int]]: ...


class WordReader(Protocol):
    def words(self, image: bytes, psm: int) -> list[dict]: ...


class Predictor(Protocol):
    def predict(self, labels: DataFrame) -> DataFrame: ...


class MockBackend:
    """Answers every field by a hash of the image; the same image gives the same answer."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def chat(self, *, prompt: str, images: list[bytes], json_schema: dict, temperature: float, max_tokens: int) -> str:
        h = hashlib.sha256(b"".join(images)).hexdigest()
        return json.dumps({f: [h[:6]] if v["type"] == "array" else h[:8] for f, v in json_schema["properties"].items()})


class MockRasteriser:
    """A file's pages are the stretches between form feeds; no picture is made."""

    def pages(self, name: str, content: bytes, dpi: int) -> list[tuple[bytes, int, int]]:
        return [(p, int(8.5 * dpi), 11 * dpi) for p in content.split(b"\f")] if name.lower().endswith(".pdf") else [(content, int(8.5 * dpi), 11 * dpi)]


class MockWordReader:
    """Words of a page that is plain text, on a grid."""

    def words(self, image: bytes, psm: int) -> list[dict]:
        out = []
        for n, line in enumerate(image.decode("utf-8", "replace").splitlines()):
            x = 0
            for w in line.split(" "):
                out.append({"text": w, "block_num": 1, "par_num": 1, "line_num": n, "left": x, "top": 20 * n, "width": 8 * len(w), "height": 16})
                x += 8 * len(w) + 8
        return out


_BACKENDS: dict[str, Callable[[Settings], VisionBackend]] = {"mock": MockBackend}


def register_backend(name: str, make: Callable[[Settings], VisionBackend]) -> None:
    """Adds a local or remote model; remote ones are used only if a setting names them."""
    _BACKENDS[name] = make


def backend_maker(settings: Settings) -> Callable[[Settings], VisionBackend]:
    """Looked up on the driver and sent to the workers, which know no registered backends."""
    if settings.vlm_backend not in _BACKENDS:
        raise ValueError(f"unknown backend {settings.vlm_backend!r}; there are {sorted(_BACKENDS)}")
    return _BACKENDS[settings.vlm_backend]


def get_backend(settings: Settings) -> VisionBackend:
    return backend_maker(settings)(settings)


def rasterise(files: DataFrame, settings: Settings, make: Callable[[], Rasteriser] = MockRasteriser) -> DataFrame:
    """source_file, page_no, image, width, height, error of each page; a file that can't be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = make()
        for batch in batches:
            rows = []
            for name, content in zip(batch["source_file"], batch["content"], strict=True):
                try:
                    rows += [(name, k, image, w, h, None) for k, (image, w, h) in enumerate(port.pages(name, bytes(content or b""), settings.pdf_render_dpi), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source_file", "page_no", "image", "width", "height", "error"]).astype({"page_no": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("source_file", "content").mapInPandas(run, "source_file string, page_no int, image binary, width int, height int, error string")


class Cropper(Protocol):
    def crop(self, image: bytes, box: tuple[int, int, int, int]) -> bytes: ...


class MockCropper:
    """No picture: the region's corners beside the page's bytes."""

    def crop(self, image: bytes, box: tuple[int, int, int, int]) -> bytes:
        return repr(box).encode() + image


#: What the model is asked about a region, and the form of its answer (fixed values).
CHECKBOX_PROMPT = "Which of these boxes are ticked in the picture: {options}? {many} Answer with JSON: {{\"selected\": [...]}}; use [\"NA\"] if none is."
CHECKBOX_SCHEMA = {"type": "object", "properties": {"selected": {"type": "array", "items": {"type": "string"}}}, "required": ["selected"]}
CHECKBOX_TOKENS = 200


def ask_regions(regions: DataFrame, settings: Settings, crop: Callable[[], Cropper] = MockCropper) -> DataFrame:
    """responses with a column field: one answer for each region (source_file, page_no, field, options, multi, image, vx1 to vy2)."""

    make = backend_maker(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend, cropper = make(settings), crop()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    prompt = CHECKBOX_PROMPT.format(options=", ".join(r.options), many="Several may be." if r.multi else "One at most is.")
                    part = cropper.crop(bytes(r.image or b""), (int(r.vx1), int(r.vy1), int(r.vx2), int(r.vy2)))
                    raw = backend.chat(prompt=prompt, images=[part], json_schema=CHECKBOX_SCHEMA, temperature=0.0, max_tokens=CHECKBOX_TOKENS)
                    rows.append((r.source_file, r.page_no, r.field, "checkbox", raw, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.source_file, r.page_no, r.field, "checkbox", None, str(e)))
            yield pd.DataFrame(rows, columns=["source_file", "page_no", "field", "task", "raw", "error"])

    return regions.mapInPandas(run, "source_file string, page_no int, field string, task string, raw string, error string")


def read_words(pages: DataFrame, make: Callable[[], WordReader] = MockWordReader, psm: int = 6) -> DataFrame:
    """words: one row per token of each page, with the page's size; a page is read once for all groups that look at it."""
    names = ["text", "block_num", "par_num", "line_num", "left", "top", "width", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = make()
        for batch in batches:
            rows = []
            for name, page, image, width, height in zip(batch["source_file"], batch["page_no"], batch["image"], batch["width"], batch["height"], strict=True):
                try:
                    rows += [(name, page, width, height, k, *(w[n] for n in names)) for k, w in enumerate(port.words(bytes(image or b""), psm))]
                except Exception:  # noqa: BLE001, S112
                    continue
            yield pd.DataFrame(rows, columns=["source_file", "page_no", "page_width", "page_height", "token_idx", *names])

    ints = ", ".join(f"{n} int" for n in names[1:])
    return pages.where("page_no is not null").select("source_file", "page_no", "image", "width", "height").mapInPandas(run, f"source_file string, page_no int, page_width int, page_height int, token_idx int, text string, {ints}")


def ask_pages(pages: DataFrame, settings: Settings, prompt: str) -> DataFrame:
    """responses: source_file, page_no, task, raw, error; write them before use, a model isn't asked twice."""

    make = backend_maker(settings)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make(settings)
        for batch in batches:
            rows = []
            for name, page, image in zip(batch["source_file"], batch["page_no"], batch["image"], strict=True):
                try:
                    raw = backend.chat(prompt=prompt, images=[bytes(image or b"")], json_schema=json_schema(page_schema(int(page))), temperature=settings.temperature, max_tokens=settings.max_new_tokens)
                    rows.append((name, page, "page", raw, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, page, "page", None, str(e)))
            yield pd.DataFrame(rows, columns=["source_file", "page_no", "task", "raw", "error"])

    return pages.where("page_no is not null").select("source_file", "page_no", "image").mapInPandas(run, "source_file string, page_no int, task string, raw string, error string")
