"""Files in the shared folder, written and read by tasks."""

from strandloom.sources.files import open_file, write_file

__all__ = ["open_file", "write_file"]
