"""From SQL text to DataFrame plans: lexer, syntax tree, parser and binder."""
