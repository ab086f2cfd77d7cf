from .scratch import checkpointed, kept, scratch_dir
from .tables import read_table, result_schema, rows_to_frame, schema_report, write_table

__all__ = [
    "checkpointed",
    "kept",
    "read_table",
    "result_schema",
    "rows_to_frame",
    "schema_report",
    "scratch_dir",
    "write_table",
]
