"""The stateful operators over streams."""
