"""The query catalogue and its SQL twins."""
