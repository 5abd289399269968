"""Plans: what is derived from resolved masks and page states."""
