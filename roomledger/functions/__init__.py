"""Column -> Column functions: text, numbers, flags, HTML, embedded JSON, composition."""
