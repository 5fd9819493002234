"""Writers: feature exports, manifests, promotion, ingest records."""
