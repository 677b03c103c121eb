"""panelkit.operators."""
