"""Sources and sinks: the driver's parquet tables, the reference's file formats
(tagged text, lists, gold keys, CSV/TSV/JSON corpora, stopwords, dictionaries)
and the phrase / scored-term sinks."""
