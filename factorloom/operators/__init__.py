"""Distributed operators over panels."""
