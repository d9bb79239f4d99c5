"""Readers that turn landed files and payloads into typed rows."""
