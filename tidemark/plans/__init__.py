"""Domain views and one query per operator; importing `all_queries` registers them all."""
