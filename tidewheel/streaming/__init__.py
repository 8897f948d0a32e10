"""The dialect has no streaming operators; batch frames of this library also run in ``foreachBatch``."""
