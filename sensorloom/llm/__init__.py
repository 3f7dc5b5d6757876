"""Training-data operators: one module for each, every one usable on its own DataFrame."""
