"""Asynchronous forms of operators, choice of resources for work, and windowed streams."""
