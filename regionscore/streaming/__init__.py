"""The proposal feed."""
