"""Multi-step plans: index builds, searches and cost models."""
