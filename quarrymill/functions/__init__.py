"""Column functions: texts, topics, prompts, answers, metrics of one row."""
