"""Types of the dialect and what can be done with their values."""
