"""Independent SQL for the registered reports."""
