"""Reading sources with declared schemas and writing results."""

from .ordered import manifest, write_ordered_csv
from .reader import read_csv, read_source, read_sources, read_sources_checked, read_tree_census, typed
from .rejects import Checked, parse_lines, read_checked, to_lines
from .schemas import SOURCES, TREE_COLUMNS, TREE_POSITIONS, SourceSpec
from .writer import write_csv, write_parquet

__all__ = [
    "Checked",
    "SOURCES",
    "SourceSpec",
    "TREE_COLUMNS",
    "TREE_POSITIONS",
    "manifest",
    "parse_lines",
    "read_checked",
    "read_csv",
    "read_source",
    "read_sources",
    "read_sources_checked",
    "read_tree_census",
    "to_lines",
    "typed",
    "write_csv",
    "write_ordered_csv",
    "write_parquet",
]
