"""DataFrame operators (P, L, U, K, C, V, E, M, Q of the survey)."""
