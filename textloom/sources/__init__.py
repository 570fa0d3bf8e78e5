"""Where the relations come from."""
