"""Page-document analytics: plans."""
