"""Training-data operators: one module each, free of imports from the rest of the library."""
