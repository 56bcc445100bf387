"""Part of chronolex; see the README for the map of modules."""
