"""Feature store, models and end-to-end jobs."""
