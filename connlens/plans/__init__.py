"""Jobs: the operators put together, reading and writing stored tables."""
