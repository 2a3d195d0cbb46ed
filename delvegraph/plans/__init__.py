"""Plan construction: the graph query language and staged (iterative) plans."""
