"""Where documents come from: files, stored containers and tables."""
