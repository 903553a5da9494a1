"""Analytics over time-evolving graphs, as DataFrame transformations."""
