"""Column-level building blocks: text normalisation, predicates, n-gram and
phrase-position expressions, the fixture tag rule and the vocabulary stemmer.
All of them are built-in Spark expressions (codegen, no Python per row) except
the stemmer, which runs once per distinct word as an Arrow batch function."""
