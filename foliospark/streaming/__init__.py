"""Page-document analytics: streaming."""
