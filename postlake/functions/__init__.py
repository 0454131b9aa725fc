"""Column expressions: text, URLs, HTML, XML, JSON variants and dates."""
