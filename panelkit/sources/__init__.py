"""panelkit.sources."""
