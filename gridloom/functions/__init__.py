"""See README.md for the layout of the package."""
