"""Reports: what is written, from bounded rows."""
