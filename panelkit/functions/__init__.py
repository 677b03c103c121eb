"""panelkit.functions."""
