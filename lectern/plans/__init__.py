"""Plan-level helpers: scratch tables, size-checked broadcasts, spreading of small scans."""
