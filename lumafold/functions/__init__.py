"""Column expressions: complex arithmetic, deterministic uniforms, rounding."""
