"""Table operators: discovery, chunks, vectors, search, evaluation, maintenance, registry and jobs."""
