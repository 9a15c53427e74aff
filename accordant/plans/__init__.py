"""Multi-step plans that put operators together, and the registered queries."""
