"""Named queries over the tables of a data directory, with the equivalent SQL where there is one."""
