"""Check requests and page figures as streams."""
