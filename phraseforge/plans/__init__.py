"""Registered queries (``queries.py``) and their DuckDB oracles (``oracle.py``).

Each query reads the driver's tables from ``sf_dir`` and composes operators
from :mod:`phraseforge.operators`; outputs are shaped for comparison (doubles
rounded to 6 places, arrays joined into strings)."""
