"""Multi-stage jobs: document lint, scoring, screening."""
