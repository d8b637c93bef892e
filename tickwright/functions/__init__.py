"""Column functions and the shared window helpers."""
