"""Parameters with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    seed: int = 42
    chunk_tokens: int = 256
    overlap: int = 32
    k: int = 10
    k_step: int = 10
    k_max: int = 40
    weak_threshold: float = 0.35
    max_steps: int = 8
    budget: float = 0.05
    score_thr: float = 0.5
    dim: int = 768
    max_cer: float = 0.15
    min_line_chars: int = 1
    max_line_diff: int = 4
    min_line_similarity: float = 0.5
    min_line_height: int = 8
    min_line_area: int = 40
    blank_ink: float = 0.002
    min_pages: int = 300
    min_words: int = 60_000
    model: str = "multilingual-e5-base"
    ocr_lang: str = "eng"
    ocr_oem: int = 1
    line_psm: int = 7
    page_psm: int = 4
    index_kind: str = "exact"


DEFAULT = Config()


def parsed(text: str) -> dict:
    """A mapping from `key: value` lines; deeper indentation nests, # starts a comment, values are JSON or else text."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        key, colon, value = body.strip().partition(":")
        if not colon:
            raise ValueError(f"no key in {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.strip()
        if value:
            try:
                stack[-1][1][key] = json.loads(value)
            except ValueError:
                stack[-1][1][key] = value.strip("'\"")
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def load(path: str, base: Config = DEFAULT) -> Config:
    """A Config from a file of `key: value` lines; keys may stand in sections, those that no parameter has are ignored."""
    with open(path, encoding="utf-8") as f:
        found = parsed(f.read())
    flat = {k: v for part in (found, *(v for v in found.values() if isinstance(v, dict))) for k, v in part.items() if not isinstance(v, dict)}
    return replace(base, **{f.name: flat[f.name] for f in fields(base) if f.name in flat})


def snapshot(config: Config) -> str:
    """The parameters as JSON with sorted keys."""
    return json.dumps(asdict(config), sort_keys=True)
