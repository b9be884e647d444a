"""From SQL text to resolved plans: tokens, statements, names and the plan tree."""
