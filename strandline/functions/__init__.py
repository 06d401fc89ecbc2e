"""Column functions: text, answers, tool calls, arithmetic, hashes."""
