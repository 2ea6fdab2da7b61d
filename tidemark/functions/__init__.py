"""Column functions: paths, rules, contents, redaction."""
