"""latentspark: ordered-panel analytics, latent-regime models and corpus preparation on Spark."""
