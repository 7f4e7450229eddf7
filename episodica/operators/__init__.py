"""DataFrame operators over steps and episodes."""
