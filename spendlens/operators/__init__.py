"""Table-level operators: views, reports, rule-checked writes, admission, digest, text."""
