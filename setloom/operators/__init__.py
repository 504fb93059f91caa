"""DataFrame -> DataFrame operators keyed by ``study_id``."""
