"""Part of panelwright; see README.md."""
