"""Page-document analytics: operators."""
