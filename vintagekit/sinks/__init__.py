"""Writers: append-only tables, stable files, feeds, manifests and published versions."""
