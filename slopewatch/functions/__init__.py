"""Pure Column builders: arithmetic, geometry, scoring and text."""
