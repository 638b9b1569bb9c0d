"""Orders in which adjacent segments can be merged pairwise."""
