"""Column functions: text, validators, extractors, rules, product profile, fusion, metrics, JSON."""
