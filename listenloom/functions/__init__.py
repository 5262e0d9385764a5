"""Part of listenloom; see the README for the map of modules."""
