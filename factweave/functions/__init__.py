"""Part of the factweave engine; see the README for the map."""
