"""Sources by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from . import metadata, tracks
from .common import Scenes

#: Part of a dataset's name -> reader.
READERS: dict[str, Callable] = {
    "eupeds": tracks.walkers,
    "sdd": tracks.drone,
    "interaction": tracks.junction_cases,
    "av2": tracks.scenarios,
    "sind": tracks.junction_tracks,
    "waymo": tracks.nested_tracks,
    "nuplan": tracks.log_states,
    "nusc": tracks.annotated_samples,
    "vod": tracks.annotated_samples,
    "lyft": tracks.frame_intervals,
}


def reader(name: str) -> tuple[Callable, bool]:
    """The reader of a dataset, found by a part of its name, and whether it has maps."""
    for part, found in READERS.items():
        if part in name:
            return found, metadata.of(part).has_maps
    raise ValueError(f"no source for {name!r}")


def tables_of(name: str) -> list[str]:
    """The tables or paths that the reader of a dataset asks for, in order; what has a default isn't among them."""
    asked = inspect.signature(reader(name)[0]).parameters.values()
    return [p.name for p in asked if p.default is p.empty]


def read(name: str, **given) -> Scenes:
    """The scenes of a dataset by its name. ``given`` holds what its reader asks for; anything missing or unknown is an error."""
    found = reader(name)[0]
    missing = [t for t in tables_of(name) if t not in given]
    unknown = [t for t in given if t not in inspect.signature(found).parameters]
    if missing or unknown:
        raise ValueError(f"{name}: missing {missing}, unknown {unknown}")
    return found(**given)


def scene_tags(name: str, parts: list[list[str]]) -> list[list[str]]:
    """The tags of a dataset: its name with one of each list of parts."""
    tags = [[name]]
    for choices in parts:
        tags = [[*t, c] for t in tags for c in choices]
    return tags
