"""Reading datasets from files."""

from .files import FORMATS, file_label, read_dataset

__all__ = ["FORMATS", "file_label", "read_dataset"]
