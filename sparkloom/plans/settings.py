"""Where packs of a user go: a folder pinned for a project, else a general one, else none."""

from __future__ import annotations

import json
import os

DEFAULT = {"output_dir": "", "project_output_dirs": {}}


def load(path: str) -> dict:
    """What is missing or malformed is as by default."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    return {
        "output_dir": data["output_dir"] if isinstance(data.get("output_dir"), str) else "",
        "project_output_dirs": {k: v for k, v in data["project_output_dirs"].items() if isinstance(v, str)} if isinstance(data.get("project_output_dirs"), dict) else {},
    }


def save(path: str, settings: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2)


def pin(path: str, project: str, folder: str) -> None:
    own = load(path)
    own["project_output_dirs"][os.path.abspath(project)] = folder
    save(path, own)


def output_dir(path: str, project: str) -> str:
    own = load(path)
    return own["project_output_dirs"].get(os.path.abspath(project)) or own["output_dir"]


def output_path(path: str, project: str) -> str:
    folder = output_dir(path, project)
    return os.path.join(folder, f"{os.path.basename(os.path.abspath(project))}.json") if folder else ""
