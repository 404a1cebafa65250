"""Streaming of listingflow."""
