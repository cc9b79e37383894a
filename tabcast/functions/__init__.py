"""Column expressions: text, dates, bands and the fixed vocabularies."""
