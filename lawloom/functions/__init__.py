"""Pure functions behind the operators; none of them needs a session."""
