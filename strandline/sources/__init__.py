"""Readers: planning CSV, JSON-lines manifests, verified bundles, part discovery and layered caches."""
