"""Reading, checking and preparing panels."""
