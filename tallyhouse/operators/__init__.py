"""DataFrame-to-DataFrame transforms; nothing here reads or writes."""
