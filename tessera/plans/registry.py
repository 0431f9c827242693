"""All registered core queries and their SQL."""

from . import files, references, retrieval, training

QUERIES = {**references.QUERIES, **retrieval.QUERIES, **files.QUERIES, **training.QUERIES}
ORACLE = {**references.ORACLE, **retrieval.ORACLE, **files.ORACLE, **training.ORACLE}
