"""panelkit.plans."""
