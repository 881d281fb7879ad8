"""Rule-driven script conversion as Catalyst column expressions."""
