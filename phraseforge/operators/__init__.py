"""Relational operators over the ``tokens(doc_id, pos, word, tag)`` table:
candidate runs, TF-IDF, co-occurrence graphs and their rankers, document
similarity, n-gram TF-IDF, dictionary matching, topic keywords and evaluation."""
