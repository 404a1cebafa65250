"""Sources of listingflow."""
