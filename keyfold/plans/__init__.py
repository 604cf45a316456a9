"""Query text and literals to analysed plans."""
