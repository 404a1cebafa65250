"""Plans of listingflow."""
