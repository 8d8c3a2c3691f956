"""Graph, vector, ranking and consolidation operators over a pinned view."""
