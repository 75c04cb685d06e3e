"""Jobs that put sources, functions and operators together."""
