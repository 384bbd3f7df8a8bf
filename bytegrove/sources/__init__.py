"""Where contents come from."""
