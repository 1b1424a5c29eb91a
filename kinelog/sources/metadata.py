"""What is known of a source before it is read: timestep, maps, parts, splits, and what scene names say.

Lists of scenes are short (names, not rows), so splits are worked out on the driver and joined as small tables; names are
parsed by column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seconds between two timesteps of each source, by a part of its name.
TIMESTEPS = {"eupeds": 0.4, "sdd": 1 / 30, "interaction": 0.1, "av2": 0.1, "sind": 0.1, "waymo": 0.1, "nuplan": 0.05, "nusc": 0.5, "vod": 0.1, "lyft": 0.1}
#: Sources without maps, and those whose scenes can't be read apart from each other.
NO_MAPS, NOT_APART = frozenset({"eupeds", "sdd"}), frozenset({"nusc"})
#: Beginning of a junction's name -> country; names of other countries begin otherwise.
COUNTRIES = {"DR_DEU": "germany", "DR_CHN": "china", "DR_USA": "usa"}
ELSEWHERE = "bulgaria"


@dataclass(frozen=True)
class Metadata:
    """Name, timestep, parts whose product are the tags, and the split of each scene."""

    name: str
    dt: float
    has_maps: bool
    apart: bool
    parts: list[list[str]] = field(default_factory=list)
    splits: dict[str, str] = field(default_factory=dict)
    more_tags: list[list[str]] = field(default_factory=list)

    def tags(self) -> list[list[str]]:
        """The name with one of each part, then the tags that are no product."""
        found = [[self.name]]
        for choices in self.parts:
            found = [[*t, c] for t in found for c in choices]
        return found + [[self.name, *t] for t in self.more_tags]

    def split_table(self, spark: SparkSession) -> DataFrame:
        """(name, data_split) of each scene that has one."""
        return spark.createDataFrame(sorted(self.splits.items()), "name string, data_split string")


def of(name: str, **more) -> Metadata:
    """The metadata of a source, found by a part of its name."""
    for part, dt in TIMESTEPS.items():
        if part in name:
            return Metadata(name, dt, part not in NO_MAPS, part not in NOT_APART, **more)
    raise ValueError(f"no source for {name!r}")


def inverted(splits: dict[str, list[str]]) -> dict[str, str]:
    """Scene -> split; of a scene in two splits the later one counts."""
    return {scene: split for split, scenes in splits.items() for scene in scenes}


def with_validation(splits: dict[str, list[str]], n: int, of: str = "train") -> dict[str, list[str]]:
    """Splits with the first n scenes of one set apart for validation in training (``train_val``)."""
    return {**splits, of: splits[of][n:], f"{of}_val": splits[of][:n]}


def one_left_out(every: list[str], left_out: list[str]) -> dict[str, list[str]]:
    """Splits of halls of which some are left out: their own train and val parts, those of the others (``_loo``), and the test set."""
    rest = [s for s in every if s not in left_out]
    return {
        "train": [f"{s}_train" for s in left_out], "val": [f"{s}_val" for s in left_out],
        "train_loo": [f"{s}_train" for s in rest], "val_loo": [f"{s}_val" for s in rest], "test_loo": list(left_out),
    }


# What names say.


def junction_split(name: Column, with_case: bool = True) -> Column:
    """The split in a junction scene's name, before the number of its case if it has one."""
    bare = F.regexp_replace(name, r"_[0-9]+$", "") if with_case else name
    return F.when(bare.endswith("test_condition"), "test_condition").otherwise(F.element_at(F.split(bare, "_"), -1))


def junction_place(name: Column) -> tuple[Column, Column]:
    """Country and place in a junction scene's name; names of the other country have one part less."""
    country = F.lit(ELSEWHERE)
    for begins, c in COUNTRIES.items():
        country = F.when(name.startswith(begins), c).otherwise(country)
    parts = F.split(name, "_")
    return country, F.array_join(F.slice(parts, F.lit(2), F.when(country == ELSEWHERE, 2).otherwise(3)), "_")


def packed(name: Column, delimiter: str = "_") -> tuple[Column, Column]:
    """What comes before the first delimiter (a split, a city) and what comes after it."""
    return F.substring_index(name, delimiter, 1), F.substring(name, F.instr(name, delimiter) + len(delimiter), F.length(name))
