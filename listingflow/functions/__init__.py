"""Functions of listingflow."""
