"""DataFrame operators: retrieval, query language, jobs, sessions, run trees, logs and documents."""
