"""Prompts, response schemas and configuration by name: from the caller's folders first, else those built in."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from refminer.operators.extraction import PROMPT

BUILT_IN: dict[str, str] = {
    "datasets": PROMPT,
    "metadata": 'Describe the dataset of the page below as one JSON object with the keys {keys}; leave out what the page does not say.\nKnown: {known}\nPage: {content}',
    "pages_to_read": 'Which of the pages linked below are needed to describe the dataset? Answer {"urls": [...]}.\nPage: {content}',
    "description": "Describe the dataset {dataset} as the paper below does, in one JSON object with the key description.\nPaper: {content}",
    "keywords": "List keywords of each file below, as one JSON list of strings, in the order of the files.\n{content}",
}
SCHEMAS: dict[str, dict[str, Any]] = {
    "datasets": {"type": "object", "properties": {"datasets": {"type": "array", "items": {"type": "object", "properties": {n: {"type": "string"} for n in ("dataset_identifier", "data_repository", "dataset_webpage")}, "required": ["dataset_identifier", "data_repository"]}}}},
    "description": {"type": "object", "properties": {"description": {"type": "string"}}, "required": ["description"]},
}


def _find(name: str, folders: tuple[str, ...], suffixes: tuple[str, ...]) -> str | None:
    for folder in folders:
        for suffix in suffixes:
            path = Path(folder) / f"{name}{suffix}"
            if path.is_file():
                return path.read_text(encoding="utf-8")
    return None


def load_prompt(name: str, folders: tuple[str, ...] = ()) -> str:
    """The template called name: name.txt, name.md or name.json (its 'prompt') of the first folder that has one, else the one built in."""
    found = _find(name, folders, (".txt", ".md"))
    if found is None and (raw := _find(name, folders, (".json",))) is not None:
        value = json.loads(raw)
        found = value["prompt"] if isinstance(value, dict) and "prompt" in value else raw
    if found is None and name not in BUILT_IN:
        raise KeyError(name)
    return BUILT_IN[name] if found is None else found


def load_schema(name: str, folders: tuple[str, ...] = ()) -> dict[str, Any]:
    """The JSON schema called name, of the first folder that has name.json, else the one built in."""
    raw = _find(name, folders, (".json",))
    if raw is None and name not in SCHEMAS:
        raise KeyError(name)
    return dict(json.loads(raw)) if raw is not None else SCHEMAS[name]


def load_config(name: str, folders: tuple[str, ...]) -> dict[str, Any]:
    """name.json of the first folder that has it; a KeyError where none has."""
    raw = _find(name.removesuffix(".json"), folders, (".json",))
    if raw is None:
        raise KeyError(name)
    return dict(json.loads(raw))


def conforms(value: Any, schema: dict[str, Any]) -> bool:
    """Whether a JSON value has a schema's types, required keys and items (the parts of JSON Schema that answers need)."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    if kind is not None and not isinstance(value, kinds[kind]):
        return False
    if isinstance(value, dict):
        return all(k in value for k in schema.get("required", ())) and all(conforms(value[k], s) for k, s in schema.get("properties", {}).items() if k in value)
    if isinstance(value, list) and "items" in schema:
        return all(conforms(v, schema["items"]) for v in value)
    return True
