"""Part of loomwork; see the README."""
