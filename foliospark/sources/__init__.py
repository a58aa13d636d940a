"""Page-document analytics: sources."""
