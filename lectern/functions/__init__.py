"""Column expressions: text, hashing, question understanding, rubric helpers, markdown blocks."""
