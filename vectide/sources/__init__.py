"""Storage: snapshots with a manifest, and the JSON bridge."""
