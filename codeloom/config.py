"""Languages and their file extensions."""

from __future__ import annotations

import json

# Extensions by language. C stands for C and C++.
LANGUAGES = {"C": [".c", ".cpp", ".hpp", ".cc", ".cxx", ".hh", ".h"], "Java": [".java"]}


def load_languages(path: str | None = None) -> dict[str, list[str]]:
    """From a JSON file {"languages": [{"name", "extensions"}]}; a missing file, bad JSON and a missing key are different errors."""
    if path is None:
        return LANGUAGES
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if "languages" not in data:
        raise KeyError("languages")
    return {x["name"]: list(x["extensions"]) for x in data["languages"]}


def by_extension(languages: dict[str, list[str]] | None = None) -> dict[str, str]:
    """The first language that claims an extension."""
    out: dict[str, str] = {}
    for name, extensions in (languages or LANGUAGES).items():
        for e in extensions:
            out.setdefault(e, name)
    return out
