"""Column functions: all are built-in expressions inside whole-stage code generation."""
