"""Settings of a library, from a JSON file over defaults."""

from __future__ import annotations

import copy
import json
from typing import Any

#: Sizes of pages, thresholds and modes where the file says nothing.
DEFAULTS: dict[str, Any] = {
    "collection": {
        "editor": {"fileSearch": {"pageSize": 20, "sort": {"isDesc": True, "key": "dateCreated"}}, "search": {"pageSize": 50, "sort": {"isDesc": False, "key": "custom"}}},
        "manager": {"search": {"pageSize": 30, "sort": {"isDesc": True, "key": "dateCreated"}}},
    },
    "db": {"fileStorage": {"locations": ["FileStorage"], "threshold": 0.99}},
    "file": {
        "reencode": {"codec": "hevc_nvenc", "maxBitrate": 5000, "maxFps": 60, "maxHeight": 1080, "maxWidth": 1920},
        "remuxTypes": {"toMp4": ["ts"]},
        "search": {"pageSize": 100, "sort": {"isDesc": True, "key": "dateCreated"}},
    },
    "imports": {
        "deleteOnImport": True, "folderDelimiter": ";;", "folderToCollMode": "none", "folderToTagsMode": "none", "ignorePrevDeleted": True,
        "labelDiff": "Diffusion", "labelDiffModel": "Diffusion Model", "labelDiffOriginal": "Diff: Original", "labelDiffUpscaled": "Diff: Upscaled",
        "manager": {"search": {"pageSize": 20, "sort": {"isDesc": True, "key": "dateCreated"}}}, "withDelimiters": True,
    },
    "tags": {"manager": {"search": {"pageSize": 50, "sort": {"isDesc": True, "key": "dateCreated"}}}},
}


def overlaid(base: Any, over: Any) -> Any:
    """base with what over says, level by level; lists are taken whole, numbers written as text become numbers where the default is one."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: overlaid(base[k], over[k]) if k in base and k in over else copy.deepcopy(over.get(k, base.get(k))) for k in {**base, **over}}
    if isinstance(base, (int, float)) and not isinstance(base, bool) and isinstance(over, str):
        return type(base)(float(over)) if float(over) == int(float(over)) else float(over)
    return copy.deepcopy(over)


def load(text: str | None) -> dict[str, Any]:
    """Settings from the text of a JSON file; the defaults where there is none or it can't be read."""
    try:
        return overlaid(DEFAULTS, json.loads(text)) if text else copy.deepcopy(DEFAULTS)
    except ValueError:
        return copy.deepcopy(DEFAULTS)


def page_size(settings: dict, entity: str) -> int:
    return {"collection": settings["collection"]["manager"], "file": settings["file"], "batch": settings["imports"]["manager"], "tag": settings["tags"]["manager"]}[entity]["search"]["pageSize"]
