"""Operators that prepare text corpora for model training. Nothing else in panelflow imports this package."""
