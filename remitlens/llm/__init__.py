"""Operators that turn raw documents and pages into training data. Nothing outside this subpackage imports it."""
