"""panelkit.streaming."""
