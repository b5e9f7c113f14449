"""The stateless cleaning steps run unchanged on a streaming text source."""
