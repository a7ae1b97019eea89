"""Column functions, rule evaluation and rule presets."""
