"""The operators applied to the provided tables, with equivalent SQL for checking."""
