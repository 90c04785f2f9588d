"""Names of enumerations, and casts of named values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results name these.
OCCUPANCY_TYPES = {-2: "null", -1: "uncertain", 0: "free", 1: "occupied"}
NDT_MODES = {0: "none", 1: "occupancy", 2: "traversability"}
HEIGHTMAP_MODES = {0: "planar", 1: "fill", 2: "layered-unordered", 3: "layered"}
MAP_FLAGS = {1: "VoxelMean", 2: "Compressed", 4: "Traversal"}
DATA_TYPES = {0: "<unknown>", 1: "int8_t", 2: "uint8_t", 3: "int16_t", 4: "uint16_t", 5: "int32_t", 6: "uint32_t", 7: "int64_t", 8: "uint64_t", 9: "float", 10: "double", 11: "struct"}
UNKNOWN = "<unknown>"


#: What a value without a name is called, where it isn't UNKNOWN; and what a name without a value stands for.
NO_FLAG, NO_MODE = "None", 0


def name_of(value: Column, names: dict[int, str], other: str = UNKNOWN) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), value.cast("int")), F.lit(other))


def flag_name(flags: Column) -> Column:
    """The name of the lowest flag that is set."""
    out = F.lit(NO_FLAG)
    for bit in sorted(MAP_FLAGS, reverse=True):
        out = F.when(flags.bitwiseAND(bit) != 0, MAP_FLAGS[bit]).otherwise(out)
    return out


def value_or(name: Column, names: dict[int, str], other: int = NO_MODE) -> Column:
    return F.coalesce(value_of(name, names), F.lit(other))


def value_of(name: Column, names: dict[int, str]) -> Column:
    """Null for a name that isn't known."""
    pairs = [F.lit(x) for k, v in names.items() for x in (v, k)]
    return F.element_at(F.create_map(*pairs), name)
