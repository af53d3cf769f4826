"""DataFrame operators: steps (T), sampling (D), metrics (A), value (V),
prompts / inference / answers (P) and training examples (X)."""
