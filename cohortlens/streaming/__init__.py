"""Incremental drivers: re-run the batch operators on newly arriving files.

The reference only processes finished tables, so no streaming operator is
added here; this only lets a deployment feed new note/encounter files through
the same DataFrame operators with exactly-once, checkpointed micro-batches.
"""
from .incremental import run_incremental  # noqa: F401
