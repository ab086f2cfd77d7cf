from .hashing import bucket_of, unit_interval
from .text import field_of, normalized

__all__ = ["bucket_of", "field_of", "normalized", "unit_interval"]
