"""Column expressions: text measures, tag lists, answer delays."""
