"""Page-document analytics: functions."""
