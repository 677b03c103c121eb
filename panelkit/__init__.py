"""panelkit: (symbol, date) panel feature engineering joined with dated text, on Spark."""

__version__ = "0.1.0"
