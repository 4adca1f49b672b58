"""Column functions: built-in expressions, with Arrow functions only where none exists."""
