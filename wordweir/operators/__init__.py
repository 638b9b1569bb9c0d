"""Word scan, profiles, segments and merges."""
