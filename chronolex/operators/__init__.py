"""Reusable DataFrame operators: version chains, diffs, retrieval, graphs, comparison."""
