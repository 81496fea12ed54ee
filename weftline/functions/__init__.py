"""Values, actions and text: the scalar side of operations."""
